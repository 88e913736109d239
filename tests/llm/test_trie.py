"""Operator 11 against a dictionary of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from apiforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, block string, seq string, depth string"


def plain(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    seqs = {c: [v[3:] for v in sorted(vs)] for c, vs in conv.items()}
    full = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(seqs.get(c - int(math.fmod(c, 20)), [])[:h] + s[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        words = len(k[-1][1].encode().split()) if k else 0
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * words
    return sorted((min(v), len(k), min(members[k[:-1]]) if k else -1, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(
        ",".join(str(c) for c in sorted(v) if len(full[c]) == len(k)).encode()).hexdigest()) for k, v in members.items())


def check(spark, rows, least_block):
    turns = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = trie.prefix_trie(turns, least_block=least_block).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain(rows)


def talks():
    """A first turn that all share, a talk repeated hundreds of times, long ones, nulls, ties, empty and odd ids."""
    rnd, rows = random.Random(3), []
    turn = lambda: " ".join(rnd.choice("a b c d e".split()) for _ in range(rnd.randint(0, 3)))
    for c in range(-30, 90):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, rnd.choice(["user", "bot"]), turn() if rnd.random() < 0.5 else "same"))
    for c in range(1000, 1150):
        rows += [(c, t, "user", f"copied {t}") for t in range(6)]
    for c in (2000, 2001, 2003):
        rows += [(c, t, "user", "again and again") for t in range(60 + c % 3)]
    rows += [(5000, None, None, None), (5000, None, "user", "x"), (5000, 1, "user", "y"), (5000, 1, "user", "y"), (5001, 7, "", ""),
             (None, 0, "user", "nobody"), (5003, 0, "user", "a b\n c"), (2 ** 60 + 3, 0, "user", "only")]
    return rows


@pytest.mark.parametrize("least_block", [3, 64, 4096])
def test_talks(spark, least_block):
    check(spark, talks(), least_block)


def test_many_ids_pass_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_A_ROW", 2)
    rows = [(c, 0, "user", "hello") for c in range(60)]
    table = __import__("pyarrow").table({"pos": range(9), "conv_id": range(9), "key": [b"x" * 16] * 9, "words": [[1]] * 9})
    parts = trie.block_rows(0, table, 9, 20).to_pylist()
    assert [r["ids"] for r in parts if r["ids"]] == ["0,1", "2,3", "4,5", "6,7", "8"]
    check(spark, rows, 5)


def test_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranges():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 33):
        v = rng.integers(-1, 4, n)
        low = trie.Ranges(v)
        at, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(-1, 5)))
        for i, d, r, a in zip(at, depth, low.right(at, depth), low.left(at, depth)):
            assert r == next((k - 1 for k in range(i + 1, n) if v[k] < d), n - 1)
            assert a == next((k for k in range(i, -1, -1) if v[k] < d), 0)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a <= b], b[a <= b]
        assert low.least(a, b).tolist() == [v[x:y + 1].min() for x, y in zip(a, b)]
