"""A forgiving HTML reader that gives a flat tree of elements with their text, in page order."""

from __future__ import annotations

import html as entities
import re

# Names of HTML elements by what the reader does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select noframes".split())
#: Of these, what HTML reads as text to the end of the page where the end tag is missing; the others end with their parent.
TO_THE_END = frozenset("script style iframe textarea title noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends an open element of these names, up to the nearest of the containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("table td th caption html button object".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Tags whose quotation marks have no fellow, after which marks of a page are trusted no more: each costs a look at all that follows.
UNPAIRED = 8
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Page:
    """Elements in page order; 0 is the root.

    tag, parent, depth, tokens (words of class, id, role and the like), and
    ``flow``: (element, text) pieces in page order, with text None where a block begins or ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["#root"], [-1], [0], [()]
        self.flow: list[tuple[int, str | None]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        words: list[str] = []
        if "=" in attributes:
            for m in _ATTR.finditer(attributes):
                words += _TOKEN.findall(_CAMEL.sub(r"\1 \2", m[2] or m[3] or m[4] or "").lower())
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tuple(words))
        return len(self.tag) - 1

    def _text(self, at: int, text: str) -> None:
        if text:
            self.flow.append((at, entities.unescape(text) if "&" in text else text))

    def _read(self, s: str) -> None:
        """One pass: each open element is found by its name, so a page costs time in proportion to its length, however it nests."""
        open_, at, n, unpaired, endless = _Open(), 0, len(s), 0, set()
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(open_.top, s[at:])
                return
            self._text(open_.top, s[at:lt])
            after = s[lt + 1 : lt + 2]
            if not (after.isascii() and (after.isalpha() or after in "/!?")) or not after:
                self._text(open_.top, "<")
                at = lt + 1
                continue
            if after in "!?":
                end = s.find("-->", lt + 4) + 2 if s.startswith("<!--", lt) else s.find(">", lt)
                if end < lt + 2:
                    return  # a comment that does not end
                at = end + 1
                continue
            m = _TAG.match(s, lt) if unpaired < UNPAIRED else None
            if m is None:
                m = _LOOSE.match(s, lt)  # a quotation mark without its fellow ends with this tag
                unpaired += m is not None
            if m is None:
                end = s.find(">", lt)
                if end < 0:
                    return  # the page ends within a tag
                at = end + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if (k := open_.to_close(tag)) is not None:
                    self._end(open_, k, tag not in INLINE)
                continue
            if tag in RAW:
                if m[3].endswith("/") or tag in endless:
                    continue
                if end := re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at):
                    at = end.end()
                elif tag in TO_THE_END:
                    return
                else:
                    endless.add(tag)  # no later one has an end tag either
                continue
            if tag in CLOSES_P:
                self._end(open_, open_.nearest(("p",), P_SCOPE))
            if tag in ENDS:
                self._end(open_, open_.nearest(*ENDS[tag]))
            block = tag not in INLINE
            if block:
                self.flow.append((open_.top, None))
            node = self._open(tag, m[3], open_.top)
            if tag not in VOID and not (m[3].endswith("/") and not block):
                open_.push(node, tag)
            elif block:
                self.flow.append((open_.top, None))

    def _end(self, open_: _Open, k: int | None, block: bool = True) -> None:
        if k is not None:
            if block:
                self.flow.append((open_.top, None))
            open_.cut(k)


class _Open:
    """The open elements, from the root up, and for each name the places of its elements there."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    @property
    def top(self) -> int:
        return self.nodes[-1]

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all within it."""
        while len(self.nodes) > k:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, names) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((x[-1] for name in names if (x := self.places.get(name))), default=0)

    def nearest(self, names, stop) -> int | None:
        """The place of the innermost of ``names`` that no open element of ``stop`` holds apart."""
        k = self.last(names)
        return k if k and k > self.last(stop) else None

    def to_close(self, tag: str) -> int | None:
        """The place that an end tag closes; one of an inline element closes nothing beyond its block."""
        k = self.last((tag,))
        return k if k and (tag not in INLINE or k > self.blocks[-1]) else None
