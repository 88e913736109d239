"""Operators 3 and 6 against plain versions."""

import heapq
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from apiforge.llm import mixing, shards


def test_equal_groups_like_a_heap():
    rnd = random.Random(1)
    for _ in range(300):
        loads = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 6))]
        size, n = rnd.randint(1, 9), rnd.randint(0, 60)
        heap = [(x, j) for j, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n):
            x, j = heap[0]
            heapq.heapreplace(heap, (x + size, j))
        took = shards.take_equal(loads, size, n)
        assert sum(took) == n and loads == [x for _, x in sorted((j, x) for x, j in heap)]


def test_shards(docs, rows):
    got = shards.assign_shards(docs, shards=4).collect()
    facts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == facts
    homes, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        homes[r["size"], r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for r in rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 1
    plain = [0] * 4
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(loads.values()) == sorted(plain)


def test_shards_of_nothing(no_docs):
    assert shards.assign_shards(no_docs).collect() == []


def levels(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Resharing by rounds, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_targets(spark):
    rnd = random.Random(4)
    for _ in range(4):
        sizes = {s: rnd.choice([0, 1, 10, 500, 4_000]) for s in ["a", "b", "é", "z", "", None, "B"][:rnd.randint(1, 7)]}
        if not sum(sizes.values()):
            continue
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert got == pytest.approx(levels(sizes))


def uniform(i):
    return (int(md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52


def test_mix(docs, rows):
    sizes, members = Counter(), defaultdict(lambda: defaultdict(int))
    for r in rows:
        n = len((r[1] or "").encode().split())
        sizes[r[3]] += n
        members[r[3]][r[0]] += n
    target, copies = levels(sizes), {}
    for s, docs_of in members.items():
        c = target[s] / sizes[s] if sizes[s] else 0
        p, end = c - int(c), 0
        rank = {d: uniform(d) / (1 - uniform(d)) / (p / (1 - p)) for d in docs_of} if p else {}
        for d in docs_of:
            copies[s, d] = int(c)
        for d in sorted(rank, key=lambda d: (rank[d], d is not None, d or 0)):
            end += docs_of[d]
            copies[s, d] += 2 * end - docs_of[d] <= 2 * (target[s] - int(c) * sizes[s])
    got = mixing.mix(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode().split()), sizes[r[3]],
                    len((r[1] or "").encode().split()) * copies[r[3], r[0]]) for r in rows)
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == want
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_documents_repeat_rows(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            taken[r.doc_id, r["size"]] += r.taken // r["size"]
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    got = Counter((r.doc_id, n) for r in whole.collect() if (n := len((r.text or "").encode().split())))
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_odds_make_unequal_probabilities(spark):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    odds = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mixing.mix(rows, odds=odds, share=0.5).toPandas()
    even = got[got.doc_id % 2 == 0]
    assert abs(got.taken.sum() - 8_000) <= 4 and even.taken.sum() > 1.5 * got[got.doc_id % 2 == 1].taken.sum()


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
