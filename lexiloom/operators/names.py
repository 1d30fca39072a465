"""Names of working columns that no column of the user's has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(*frames: DataFrame, names: tuple[str, ...]) -> list[str]:
    """``names``, lengthened where one of the frames has such a column already, in any case."""
    used = {c.lower() for df in frames for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
