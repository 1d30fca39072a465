"""Joins of names against whole tables, held against SQL."""

import duckdb
import pytest

from lexiloom import plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["spoof_join_whole", "taken_whole", "registrable_whole", "match_join_whole"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = plans.QUERIES[name](spark, SF), con.sql(plans.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(str(tuple(r)) for r in df.collect())
    assert got and got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    if name == "spoof_join_whole":
        trusted = spark.read.parquet(f"{SF}/part.parquet")
        changed = trusted.where("p_brand < 'Brand#3'").count()
        assert 0 < df.where("verdict = 'safe'").count() <= changed < trusted.count()
