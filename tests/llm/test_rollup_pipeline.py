import glob
import os

import duckdb
import pytest

import corpus_pipeline
from lexiloom.llm import registry, rollup
from lexiloom.llm.common import stage_path, table

SF = "/root/testdata/sf0.001"


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


SCHEMA = "doc_id long, text string, source string, lang string"


def test_signed_batches(spark):
    r = rollup.Rollup(spark, stage_path(spark, "rollup-test"), compact_every=3)
    assert totals(r) == {}
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", None, None), (None, None, "s", "en"), (None, "x", "s", "en"), (1, "a", "s", "en"), (1, "a", "s", "en")], SCHEMA)
    assert r.commit(1, rollup.inserts(docs, "words-1")) and not r.commit(1, rollup.inserts(docs, "words-1"))
    assert totals(r) == {("s", "en", "words-1"): (5, 5), (None, None, "words-1"): (1, 1)}  # every row counts
    moved = spark.createDataFrame([(1, "a b c d", "t", "en")], docs.schema)
    r.commit(2, rollup.inserts(moved, "words-1").unionByName(rollup.deletes(moved, "words-1")))
    assert totals(r)["t", "en", "words-1"] == (1, 4) and totals(r)["s", "en", "words-1"] == (2, 1)
    r.commit(4, rollup.deletes(spark.createDataFrame([(1,), (99,), (2,), (None,)], "doc_id long"), "words-1"))
    assert totals(r) == {("s", "en", "words-1"): (2, 1)}
    r.commit(5, rollup.inserts(docs.limit(0), "words-1"))
    r.commit(6, rollup.inserts(moved, "words-1"))
    r.commit(7, rollup.inserts(moved, "words-1"))
    with pytest.raises(ValueError):
        r.commit(3, rollup.inserts(moved, "words-1"))
    again = rollup.Rollup(spark, r.path)
    assert again.batches() == [1, 2, 4, 5, 6, 7] and totals(again) == totals(r) == {("s", "en", "words-1"): (2, 1), ("t", "en", "words-1"): (1, 4)}
    assert sum(x["snapshot"] for x in r.log()) == 2


def test_two_writers_of_one_batch(spark, monkeypatch):
    """The second finishes while the first is between its data and its record: one of them counts, and nothing is written over."""
    path = stage_path(spark, "rollup-race")
    first, second = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], SCHEMA)
    other = spark.createDataFrame([(1, "a", "s", "en")], SCHEMA)
    own = first._commit

    def late(number, record):
        monkeypatch.setattr(first, "_commit", own)
        assert second.commit(1, rollup.inserts(docs, "words-1"))
        return own(number, record)

    monkeypatch.setattr(first, "_commit", late)
    assert not first.commit(1, rollup.inserts(other, "words-1"))
    assert totals(first) == totals(second) == {("s", "en", "words-1"): (1, 3)}


def test_two_writers_of_two_batches(spark, monkeypatch):
    """A batch that meets another one's record starts over on the new state, so its takebacks are of what is there."""
    path = stage_path(spark, "rollup-order")
    first, second = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], SCHEMA)
    revised = spark.createDataFrame([(1, "a", "s", "en")], SCHEMA)
    own = second._commit

    def late(number, record):
        monkeypatch.setattr(second, "_commit", own)
        assert first.commit(1, rollup.inserts(docs, "words-1"))
        return own(number, record)

    monkeypatch.setattr(second, "_commit", late)
    assert second.commit(2, rollup.inserts(revised, "words-1"))
    assert totals(first) == {("s", "en", "words-1"): (1, 1)} and first.batches() == [1, 2]


def test_crash_before_the_record(spark, monkeypatch):
    r = rollup.Rollup(spark, stage_path(spark, "rollup-crash"))
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], SCHEMA)
    r.commit(1, rollup.inserts(docs, "words-1"))
    own = r._commit
    monkeypatch.setattr(r, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        r.commit(2, rollup.inserts(docs, "words-2"))
    monkeypatch.setattr(r, "_commit", own)
    assert totals(r) == {("s", "en", "words-1"): (1, 3)}
    assert r.commit(2, rollup.inserts(docs, "words-2")) and totals(r) == {("s", "en", "words-1"): (1, 3), ("s", "en", "words-2"): (1, 3)}


def test_a_batch_reads_the_buckets_that_it_touches(spark):
    r = rollup.Rollup(spark, stage_path(spark, "rollup-buckets"), buckets=16)
    docs = spark.createDataFrame([(k, "a b", "s", "en") for k in range(500)], SCHEMA)
    r.commit(1, rollup.inserts(docs, "words-1"))
    r.compact()
    state = r._state(r.log(), "entries", rollup._ENTRY)
    one = state.where("bucket in (3)")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60]
    assert 0 < one.count() < 100 and len(one.inputFiles()) >= 1 and state.count() == 500


def test_bpe_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rollup.default_tokenizer())
    t.encode_special_tokens = True
    want = {}
    docs = table(spark, SF, "documents").collect()
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    for d in docs:
        if d.doc_id not in toxic:
            n, k = want.get((d.source, d.lang), (0, 0))
            want[d.source, d.lang] = (n + 1, k + len(t.encode(d.text or "", add_special_tokens=False).ids))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.token_rollup_bpe(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline(spark):
    from lexiloom.llm.common import stage

    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, before, SF), name)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "exact_dedup":
            texts = ["".join(r.text.split()) for r in after.collect()]
            assert len(texts) == len(set(texts))
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in before.collect()} and (last.groupby("sequence_id").length.sum() <= 1024).all()
    assert (last[last.piece == 0].groupby("doc_id").size().sort_index() == before.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].sort_index()).all()


def test_pipeline_on_edges(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
