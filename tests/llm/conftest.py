import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, u string, _r_file string, size string"


def make_rows():
    """Documents with nulls everywhere, empty and long texts, ties, copies, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "en", "on", "th", "er", "ré", "ß"]) for _ in range(rng.randint(1, 3)))
    say = lambda n: " ".join(word() for _ in range(n))
    base = say(200)
    near = base.split()
    near[50] = "changed"
    texts = [base, base.replace(" ", "\n"), f" {base}\t", " ".join(near), None, "", " \n\t", "a", "a", say(5), say(60), say(3000), say(120) + "\x00x", "x y z " * 40, " ", "<|endoftext|> b  c   d\n\n e", "日本語 text"]
    texts += [say(rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t), "clash", None, "x", "9") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[4], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a Parquet table of several files, as operators meet them."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(57)] + [(None, 1, 1), (3, None, None), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
