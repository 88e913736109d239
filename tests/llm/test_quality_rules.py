"""Operators 5 and 8: held-out accuracy, and rules against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from apiforge.llm import quality, rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_classifier_on_held_out_labels(given):
    docs, labels = given
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    table = got.toPandas()
    assert len(table) == docs.count() and table.score.between(0, 1).all()
    assert (table.predicted == (table.score >= 0.5)).all()
    assert (table.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in table.doc_id]).all()
    both = table.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert held[held.quality == 1].predicted.mean() > 0.97
    assert np.abs(held.score - held.quality).mean() < 0.1        # calibrated, not only ordered


def test_classifier_never_reads_held_out_labels(given):
    docs, labels = given
    flipped = labels.withColumn("quality", F.when(quality.in_fold("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


def test_contexts_are_sums_over_all_neighbours():
    places, signs = quality.index_vectors(50, 8)
    dense = np.zeros((50, 8))
    for b in range(50):
        for p, s in zip(places[b], signs[b]):
            dense[b, p] += s
    ids = np.array([3, 7, 7, 9, 0, 0, 4, 3], np.int32)
    want = np.zeros((50, 8))
    for i, a in enumerate(ids):
        for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
            if j != i:
                want[a] += dense[ids[j]]
    total = np.zeros(400)
    quality.add_contexts(total, ids, places, signs)
    assert np.allclose(total.reshape(50, 8), want)


def test_long_texts_pool_like_short_ones():
    rng = np.random.RandomState(1)
    v = rng.randn(20, 4).astype(np.float32)
    ids = rng.randint(0, 20, 70_000).astype(np.int32)
    x = v[ids].astype(np.float64)
    want = [*x.mean(0), *x.std(0), np.linalg.norm(x.mean(0)), (x[:-1] * x[1:]).sum() / len(x),
            (x[:-2] * x[2:]).sum() / len(x), math.log1p(len(x))]
    assert np.allclose(quality.pooled(ids, v), want, atol=1e-4)


def test_classifier_cases(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(-20, 1), (-20, None), (-13, 0), (1, 1), (1, 0), (None, 1), (8, 0), (15, 1), (22, 0)],
                                   "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    assert quality.classify(no_docs, labels).collect() == []
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def base(text):
    w = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(text):
    h = [xxhash.xxh64_intdigest(g, 42) for g in regex.findall(rules.GRAM, text or "")]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), a_seed) if b is not None else a_seed
             for a_seed, b in ((xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42), b) for a, b in zip(h, [*h[1:], None]))]
    return [signed(x) % rules.BUCKETS for x in h + pairs] if h else []


def test_rules(spark, docs, rows):
    trusted = [r[0] for r in rows if r[0] is not None and r[0] % 2 == 0]
    got = rules.judge(docs, spark.createDataFrame([(i,) for i in trusted], "_id long")).collect()
    raw, target = [0] * rules.BUCKETS, [0] * rules.BUCKETS
    for r in rows:
        for b in grams(r[1]):
            raw[b] += 1
            target[b] += r[0] in trusted
    ratio = rules.log_ratios(target, raw)
    want = Counter()
    for r in rows:
        b, g = base(r[1]), grams(r[1])
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        llr = sum(ratio[x] for x in g) / len(g) / rules.SCALE if g else None
        want[r[0], *b, failed, not failed and (llr or 0) * rules.SCALE >= rules.THRESHOLD, llr and round(llr, 9)] += 1
    assert Counter((*r[:-1], r.llr and round(r.llr, 9)) for r in got) == want


def test_rules_keep_clean_documents(given):
    docs, labels = given
    both = rules.judge(docs, rules.trusted_ids(labels)).join(labels, "doc_id").toPandas()
    judged = both[~both.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_rules_trust_all_labelled_documents(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = labels.select("doc_id", F.when(F.col("doc_id") % 30 > 0, "a b").otherwise("c d").alias("text"))
    trusted = rules.trusted_ids(labels)
    assert trusted.count() == 30_000
    assert {r.llr for r in rules.judge(docs, trusted).select("llr").distinct().collect()} == {0.0}   # target and raw alike


def test_rules_without_trusted_or_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "_id long")
    assert all(r.kept != r.base_failed for r in rules.judge(docs, none).collect())
    assert rules.judge(no_docs, none).collect() == []


def test_rules_run_no_python(docs, spark):
    plan = rules.judge(docs, spark.createDataFrame([(1,)], "_id long"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_fit_makes_no_object_a_number(spark):
    """The driver learns from the collected vectors themselves, not from Python numbers (32 bytes each)."""
    import tracemalloc

    n = 3_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id % 7, ' and ', id % 11, ' more') as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 7 < 3 as int) as quality")
    tracemalloc.start()
    try:
        quality.fit(docs, labels, buckets=64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * n * quality.width(quality.DIM) * 8


def test_fit_keeps_one_copy_of_the_vectors(spark, monkeypatch):
    import pyarrow as pa

    n, held = 3_000, []
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id % 7, ' and ', id % 11, ' more') as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 7 < 3 as int) as quality")
    before, train = pa.total_allocated_bytes(), quality.train

    def trained(x, y):
        held.append(pa.total_allocated_bytes() - before)
        return train(x, y)

    monkeypatch.setattr(quality, "train", trained)
    assert quality.fit(docs, labels, buckets=64)["w"]
    assert held[0] < n * quality.width(quality.DIM) * 8 // 2
