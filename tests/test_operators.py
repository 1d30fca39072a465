from pyspark.sql import functions as F

from lexiloom import operators as ops
from lexiloom import sources
from lexiloom.streaming import audit_stream, dedup_stream, normalize_stream, spoof_stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_spoofing(spark):
    trusted = frame(spark, [("paypal",), ("admin",), (None,)], "name string")
    wanted = frame(spark, [(1, "paypal"), (2, "pаypаl"), (3, "bob"), (4, None)], "id int, w string")
    got = {r.id: (r.verdict, r.hit) for r in ops.spoof_join(wanted, trusted, "w", "name").collect()}
    assert got == {1: ("exact", "paypal"), 2: ("spoof", "paypal"), 3: ("safe", None), 4: ("safe", None)}
    assert {r.id for r in ops.taken(wanted, trusted, "w", "name").collect()} == {1, 2}
    assert {r.id for r in ops.registrable(wanted, trusted, "w", "name").collect()} == {3, 4}


def test_matching(spark):
    df = frame(spark, [(1, "File"), (2, "fıle"), (3, "x"), (4, None), (5, "file")], "id int, t string")
    (row,) = ops.collision_groups(df, "t", "id", members=True).collect()
    assert (row.n, row.first_id, row.n_texts, row.ids) == (3, 1, 3, [1, 2, 5])
    assert sorted(r.id for r in ops.dedup_by_key(df, "t", "id").collect()) == [1, 3, 4]
    assert sorted(r.id for r in ops.search(ops.with_match_key(df, "t"), "FILE").collect()) == [1, 2, 5]
    assert ops.match_join(df, df.withColumnsRenamed({"id": "other", "t": "u"}), "t", "u").count() == 10
    assert ops.dedup_by_key(df.limit(0), "t", "id").count() == 0


def test_audit(spark):
    df = frame(spark, [("a", "é"), ("a", "x"), ("b", None)], "g string, t string")
    got = {r.g: (r.processed, r.already, r.changed) for r in ops.normalization_audit(df, "t", "NFD", ["g"], rollup=True).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 0), None: (3, 1, 1)}
    assert ops.compare_forms(df, "t").where("t = 'é'").first().nfd == "é"
    assert ops.quick_check_report(df.where("t is not null"), "t").agg(F.sum("n")).first()[0] == 8


def test_plans_stay_native(spark):
    df = frame(spark, [("é",)], "t string")
    for plan in (ops.normalization_audit(df, "t", "NFKC"), ops.changed_lines(df, "t", "NFD")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "reflect" not in text


def test_streams(spark, tmp_path):
    lines = [("é", "2024-01-01 00:00:00"), ("é", "2024-01-01 00:00:01"), ("pаypаl", "2024-01-01 00:00:02")]
    source = str(tmp_path / "in")
    frame(spark, lines, "line string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    stream = lambda: spark.readStream.schema("line string, ts timestamp").parquet(source)
    trusted = frame(spark, [("paypal",)], "name string")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.was_normalized for r in run(normalize_stream(stream(), "line"), "s_norm")) == [False, True, True]
    assert sorted(r.verdict for r in run(spoof_stream(stream(), trusted, "line", "name"), "s_spoof")) == ["safe", "safe", "spoof"]
    assert len(run(dedup_stream(stream(), "line", "ts"), "s_dedup")) == 2
    assert run(audit_stream(stream(), "line", "ts"), "s_audit", "complete")[0].changed == 1


def test_sources(spark, tmp_path):
    path = str(tmp_path / "lines")
    sources.write_lines(frame(spark, [("b",), (None,), ("a",)], "t string"), "t", path)
    assert sorted(r.line for r in sources.read_lines(spark, path).collect()) == ["", "a", "b"]
    keyed = str(tmp_path / "keyed")
    sources.write_keyed(ops.with_match_key(frame(spark, [("b",), ("a",)], "t string"), "t"), "match_key", keyed, 2)
    assert sources.read_table(spark, keyed, "t").count() == 2
