"""Operator 10 against all pairs by brute force."""

import random
import re

import pytest

from apiforge.llm import components, neardup
from apiforge.session import stage


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(docs, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(sets)
    for k, i in enumerate(order):
        for j in order[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def check(spark_docs, docs, width, num, den):
    got = neardup.near_duplicates(spark_docs, width=width, num=num, den=den).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == \
        plain([d for d in docs if d[0] is not None], width, num, den)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_corpus(docs, rows):
    check(docs, [r[:2] for r in rows], 3, 85, 100)


@pytest.mark.parametrize("width, num, crowd", [(5, 80, 512), (3, 85, 5)])
def test_crowds_chains_and_near_misses(spark, monkeypatch, width, num, crowd):
    """Groups whose copies differ from each other by more than the limit, around one text or in a chain."""
    monkeypatch.setattr(neardup, "FEW", 64 if crowd > 5 else 2)
    monkeypatch.setattr(neardup, "CROWD", crowd)            # parts of five rows: many tasks a bucket
    rnd = random.Random(8)
    word = lambda: "w" + str(rnd.randint(0, 10 ** 6))
    docs = []
    for _ in range(3):
        base = [word() for _ in range(200)]
        for _ in range(12):                                   # around the base: each pair differs twice as much
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append(copy)
        chain = list(base[:150])
        for _ in range(12):                                   # each like the one before only
            chain = list(chain)
            chain[rnd.randrange(len(chain))] = word()
            docs.append(chain)
    common = [word() for _ in range(60)]
    docs += [common + [word() for _ in range(60)] for _ in range(25)]     # a shared passage, no copies
    rnd.shuffle(docs)
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    check(spark.createDataFrame(docs, "doc_id long, text string"), docs, width, num, 100)


def test_nothing(no_docs):
    assert neardup.near_duplicates(no_docs).collect() == []


def test_components_of_long_chains(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1_000, 1_001), (1_001, 1_003), (1_002, 1_003)]
    random.Random(1).shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(n + 1)} | {i: 1_000 for i in range(1_000, 1_004)}
    assert len(got) == n + 5


def test_stars_need_no_round(spark, monkeypatch):
    written = []

    def counted(df, label="rows"):
        written.append(label)
        return stage(df, label)

    monkeypatch.setattr(components, "stage", counted)
    for links, tables in (([(1, 2), (3, 1), (5, 7), (5, 7), (4, 4)], 1), ([(1, 2), (3, 2), (5, 7)], 2)):
        written.clear()
        got = components.stars(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == [(1, 2), (1, 3), (5, 7)]
        assert len(written) <= tables


def test_distance_bound():
    assert neardup.farthest(1.0) == 0 and 11 <= neardup.farthest(0.85) < neardup.farthest(0.8) <= 24


def test_the_driver_plans_little(spark, monkeypatch):
    """Every written table is a plan in the driver's memory: joins and groupings of all of them together, with each round
    of pivots and a crowd."""
    planned = []

    def counted(df, label="rows"):
        planned.append(len(re.findall(r"\b(?:Join|Aggregate) ", df._jdf.queryExecution().optimizedPlan().toString())))
        return stage(df, label)

    monkeypatch.setattr(neardup, "stage", counted)
    monkeypatch.setattr(components, "stage", counted)
    monkeypatch.setattr(neardup, "FEW", 2)
    rnd = random.Random(8)
    docs = []
    for _ in range(3):
        base = ["w" + str(rnd.randint(0, 10 ** 6)) for _ in range(200)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = "w" + str(rnd.randint(0, 10 ** 6))
            docs.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(docs)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 5, 80, 100)
    assert sum(planned) <= 100


def test_no_join_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Spark takes the exploded keys of the classes, and ids, for a small part of what they are in memory: only the marked list of
    ids may reach the driver."""
    planned = []

    def seen(df, label="rows"):
        planned.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    monkeypatch.setattr(neardup, "stage", seen)
    monkeypatch.setattr(components, "stage", seen)
    monkeypatch.setattr(neardup, "FEW", 2)
    rnd = random.Random(8)
    base = ["w" + str(rnd.randint(0, 10 ** 6)) for _ in range(200)]
    rows = []
    for i in range(12):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = "w" + str(rnd.randint(0, 10 ** 6))
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows, 5, 80, 100)
    planned.append(("result", neardup.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()))
    assert {"members", "candidates", "sets", "differences", "crowd-links", "result"} <= {label for label, _ in planned}
    assert {label: plan.count("BroadcastExchange") for label, plan in planned if "BroadcastExchange" in plan and label != "sets"} == {}
    assert all(plan.count("BroadcastExchange") == 1 for label, plan in planned if label == "sets")
