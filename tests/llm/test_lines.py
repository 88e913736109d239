"""Operator 4 against all runs by brute force."""

import random
import re

import pytest

from apiforge.llm import lines
from apiforge.session import stage


def plain(docs, min_words):
    texts = {i: t for i, t in docs}
    split = {i: [] if t is None else t.split("\n") for i, t in texts.items()}
    first, gone = {}, set()
    for i in sorted(split, key=lambda i: (i is not None, i)):
        for a in range(len(split[i])):
            for b in range(a + 1, len(split[i]) + 1):
                run = tuple(split[i][a:b])
                if sum(len(x.encode().split()) for x in run) >= min_words and first.setdefault(run, (i, a)) != (i, a):
                    gone.update((i, j) for j in range(a, b))
    return {i: (len(split[i]), sum((i, j) in gone for j in range(len(split[i]))),
                None if t is None else "\n".join(x for j, x in enumerate(split[i]) if (i, j) not in gone))
            for i, t in texts.items()}


@pytest.mark.parametrize("seed, min_words", [(1, 1), (2, 3), (3, 8), (4, 20)])
def test_small_alphabet(spark, seed, min_words):
    rnd = random.Random(seed)
    docs = [(i, None if rnd.random() < 0.05 else
             "\n".join(rnd.choice(["a b", "c", "", "d e f", "g"]) for _ in range(rnd.randint(1, 14)))) for i in range(20)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in
           lines.deduped_rows(spark.createDataFrame(docs, "doc_id long, text string"), min_words=min_words).collect()}
    assert got == plain(docs, min_words)


def test_corpus(docs, rows):
    got = lines.deduped_rows(docs).collect()
    want = plain([r[:2] for r in rows], lines.MIN_WORDS)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in got} == want


def test_nothing(no_docs):
    assert lines.deduped_rows(no_docs).collect() == []


def test_the_driver_plans_little(spark, monkeypatch):
    """Every written table is a plan in the driver's memory: joins and groupings of all of them together, with runs of
    one to more than 32 lines."""
    planned = []

    def counted(df, label="rows"):
        planned.append(len(re.findall(r"\b(?:Join|Aggregate) ", df._jdf.queryExecution().optimizedPlan().toString())))
        return stage(df, label)

    monkeypatch.setattr(lines, "stage", counted)
    rnd = random.Random(9)
    single = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(45)]
    several = [" ".join(single[rnd.randrange(45)] for _ in range(rnd.choice([3, 12, 60]))) for _ in range(12)]
    docs = [(i, "\n".join([f"own {i}", *body, "end"])) for i, body in
            enumerate([single, several, single[3:], several[2:], several[:9] + single, ["x"] * 45, ["x"] * 44])]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in
           lines.deduped_rows(spark.createDataFrame(docs, "doc_id long, text string"), min_words=40).collect()}
    assert got == plain(docs, 40)
    assert any(n for _, n, _ in got.values()) and sum(planned) <= 36


def test_no_join_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Spark takes exploded rows and positions for a small part of what they are in memory: none may reach the driver."""
    planned = []

    def seen(df, label="rows"):
        planned.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    monkeypatch.setattr(lines, "stage", seen)
    rnd = random.Random(4)
    run = [f"line {rnd.randint(0, 10 ** 6)}" for _ in range(12)]
    docs = [(i, "\n".join([f"own {i}", *run, f"end {i}"])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lines.deduped_rows(df, min_words=3)
    assert {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in out.collect()} == plain(docs, 3)
    assert {"names", "runs", "ends"} <= {label for label, _ in planned}
    # the numbering of lines broadcasts a row for each partition; the result joins a join, whose size is taken for a product
    assert [label for label, plan in planned if "BroadcastExchange" in plan and label != "positions"] == []
