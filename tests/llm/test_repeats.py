"""Operator 12 against all windows as tuples."""

import random
from collections import Counter

import numpy as np
import pytest

from apiforge.llm import repeats


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def check(docs, rows, window, **how):
    got = repeats.without_repeats(docs, window=window, **how).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = [(i, *w) for i, w in zip((r[0] for r in rows), plain([r[1] for r in rows], window))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_corpus(docs, rows):
    check(docs, rows, 35)


@pytest.mark.parametrize("window, rounds", [(35, repeats.ROUNDS), (35, "rpprpprpp"), (8, "rp"), (3, "r"), (1, "")])
def test_passages(spark, window, rounds):
    """Shared passages around the window's length, at any place, overlapping, periodic, with runs of one word."""
    rnd = random.Random(window)
    word = lambda: "w" + str(rnd.randint(0, 50))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 200) for _ in range(3)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            text += [word() for _ in range(rnd.randint(0, 20))] + p[rnd.randint(0, 3):len(p) - rnd.randint(0, 3)]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(text)))
    rows += [(100, "a " * 34), (101, "b " * 35), (102, "c " * 36), (103, "d " * 300), (104, "x y z " * 40), (105, "x y z " * 13),
             (106, "e " * 40 + "f " * 40), (107, "f " * 40 + "g " * 40), (108, None), (None, "h " * 50), (None, "h " * 50), (100, "a " * 34),
             (109, "u" * 10_000 + " v"), (110, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, window, rounds=rounds)


def test_hot_passage_and_copies(spark):
    rnd = random.Random(2)
    word = lambda: "w" + str(rnd.randint(0, 10 ** 6))
    hot, rows = [word() for _ in range(60)], []
    for i in range(900):
        rows.append((i, " ".join([word() for _ in range(5)] + (hot if i % 3 == 0 else []) + [word() for _ in range(30)])))
    rows += [(2000 + i, " ".join(hot)) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, 35)


def test_nothing(no_docs):
    assert repeats.without_repeats(no_docs).collect() == []


def test_determined_symbols_are_equal_in_equal_windows():
    """What a window determines does not depend on its surroundings."""
    rng = np.random.default_rng(4)
    window = rng.integers(1, 9, 35).astype(np.uint64) * repeats._M1
    for _ in range(50):
        seen = []
        for _ in range(2):
            before, after = (rng.integers(1, 9, rng.integers(0, 30)).astype(np.uint64) * repeats._M1 for _ in range(2))
            names = np.concatenate([before, window, after])
            got = repeats.Parse(names, np.zeros(len(names), np.int64), "rpprppp")
            a, b = got.left[len(before)], got.right[len(before) + 35]
            here = (got.at[:-1] >= a) & (got.at[1:] <= b)
            seen.append([] if a >= b else [(int(x) - len(before), int(s)) for x, s in zip(got.at[:-1][here], got.symbols[here])])
        assert seen[0] == seen[1]
