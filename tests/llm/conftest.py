import random

import pytest
from pyspark.sql import types as T

WORDS = "red green blue cat dog bird runs sleeps eats the a of and to in on under over fast slow".split()
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *(T.StructField(n, T.StringType()) for n in ("id", "_id", "_doc", "_text", "size", "key", "pos", "score", "shard",
                                                "piece", "length", "component_id", "kept", "taken", "_gone", "t", "i"))])


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(n))


def corpus():
    """Nulls, empty, blank and long texts, ties, copies, near copies, repeated lines and rows."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    near = base.split()
    near[60] = "changed"
    run = "\n".join(prose(rnd, 18) for _ in range(4))
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO", "é à ü ß 中文 🙂", "<|endoftext|> x <|endoftext|>", "a\u0085b c",
             base, base, base.upper(), " ".join(near), "  ".join(near[:50]), prose(rnd, 30), prose(rnd, 30),
             run, "intro line\n" + run + "\nlast line", run + "\n" + run, "x y z\n" * 40, "### %%% *** " * 30,
             prose(rnd, 25_000), "The The The The " * 60, "x" * 5_000]
    texts += [prose(rnd, rnd.randint(1, 90)) for _ in range(30)]
    sources = [None, "a", "b", "b", "b", "c", "d", "", "é"]
    rows = [(i * 7 - 20, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[14])                                   # a repeated row
    rows.append((None, "no id at all but some words in it", None, None, None))
    return [r + ("clash",) * (len(DOCS) - 5) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
