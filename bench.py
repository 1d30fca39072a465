"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


#: Characters of about 1 MB for each kind of input: what one 10 kB text repeats.
KINDS = {
    "ascii": "The quick brown fox jumps over the lazy dog. ", "latin1": "Déjà vu à Zürich, où l'été naît, señor Ångström çà et là. ", "cjk": "".join(map(chr, range(0x4E00, 0x4E40))),
    "arabic": "مرحبا بالعالم هذا نص عربي للاختبار ", "hangul": "".join(map(chr, range(0xAC00, 0xAC40))), "emoji": "😀😃👍🏽👩‍💻🇺🇳❤️ ", "mixed": "Plain, déjà vu, 日本語, 한국어, مرحبا, 😀 ﬁ ①. ",
    "composed": "éèêëàâäôöûüçñ ", "marks": "a" + "́̀̂̃̈̊" * 5,
}


def kinds(spark, X, F, cpus: int) -> dict[str, dict[str, float]]:
    """MB a second of the functions over each kind of input; beside the headline figure, not in it."""
    out: dict[str, dict[str, float]] = {}
    for kind, unit in KINDS.items():
        text = unit * (10_000 // len(unit.encode()) + 1)
        rows = spark.createDataFrame([(text,)] * 400, "text string").repartition(cpus).cache()
        mb = rows.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
        todo = {**{f.lower(): X.normalize("text", f) for f in ("NFC", "NFD", "NFKC", "NFKD")}, "casefold": X.casefold("text"), "skeleton": X.skeleton("text"), "match_key": X.match_key("text")}
        out[kind] = {}
        for name, column in todo.items():
            took = []
            for _ in range(2):
                began = time.perf_counter()
                rows.select(column.alias("s")).agg(F.sum(F.length("s"))).collect()
                took.append(time.perf_counter() - began)
            out[kind][name] = round(mb / min(took), 1)
        rows.unpersist()
    return out


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lexiloom import functions as X
    from lexiloom import operators as ops

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").repartition(int(cpus)).cache()
    mb = docs.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    mass = lambda c: docs.agg(F.sum(F.length(c))).collect()
    flag = lambda c: docs.agg(F.count_if(c)).collect()
    todo = {
        **{f.lower(): (lambda f=f: mass(X.normalize("text", f))) for f in ("NFC", "NFD", "NFKC", "NFKD")},
        **{f"is_{f.lower()}": (lambda f=f: flag(X.is_normalized("text", f))) for f in ("NFC", "NFD", "NFKC", "NFKD")},
        "quick_check_nfc": lambda: flag(X.quick_check("text", "NFC") == "YES"),
        "normalize_to_nfd": lambda: docs.select(X.normalize_to("text", "NFD").alias("r")).agg(F.sum(F.length("r.text")), F.count_if("r.was_normalized")).collect(),
        "casefold": lambda: mass(X.casefold("text")),
        "skeleton": lambda: docs.select(X.skeleton("text").alias("s")).agg(F.sum(F.length("s"))).collect(),
        "match_key": lambda: docs.select(X.match_key("text").alias("s")).agg(F.sum(F.length("s"))).collect(),
        "audit_rollup": lambda: ops.normalization_audit(docs, "text", "NFD", ["lang", "source"], rollup=True).collect(),
        "collision_groups": lambda: ops.collision_groups(docs, "text", "doc_id").agg(F.sum("n")).collect(),
    }
    seconds: dict[str, float] = {}
    for name, run in todo.items():
        run()  # compiles code and starts workers
    for _ in range(2):
        for name, run in todo.items():
            began = time.perf_counter()
            run()
            seconds[name] = min(seconds.get(name, 1e9), time.perf_counter() - began)
    out = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in seconds.items()},
        "mb_per_sec": {k: round(mb / v, 1) for k, v in seconds.items()}, "kinds_mb_per_sec": kinds(spark, X, F, int(cpus)), "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
