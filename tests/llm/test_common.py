"""Row keys and the shared folder."""

import types

import pytest

from lexiloom.llm import common, exact_dedup, mixing, simhash


def test_row_keys_beside_a_column_of_the_hidden_name(spark, tmp_path):
    rows = [(k % 7, f"text {k % 5} of some words", "s", f"m{k}") for k in range(40)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, _metadata string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    keyed = common.with_row_key(docs)
    assert keyed.select("_r_file", "_r_row").distinct().count() == 40 and keyed.select("_r_file").distinct().count() == 3
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == 5 and {r._metadata for r in left.collect()} <= {r[3] for r in rows}
    assert simhash.drop_near_copies(docs).count() == 5
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_rows_that_cannot_be_found_again_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert common.with_row_key(docs).count() == 1
    with pytest.raises(ValueError, match="read from files"):
        exact_dedup.drop_exact_copies(docs)


def test_no_local_folder_on_a_cluster(spark):
    conf = types.SimpleNamespace(get=lambda *_: None)
    context = types.SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(types.SimpleNamespace(sparkContext=context))
