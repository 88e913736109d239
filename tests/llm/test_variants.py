"""Operator 13 against all edits of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from apiforge.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, form string"


def plain(rows):
    seen = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(x.lower() if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 199 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 6:
                seen[r] += 1
    vocabulary = {w: n for w, n in seen.items() if n >= 5}
    letters, out = sorted(set("".join(vocabulary))), {}
    for w, n in vocabulary.items():
        near = {w[:k] + a + w[k:] for k in range(len(w) + 1) for a in letters}
        near |= {w[:k] + a + w[k + 1:] for k in range(len(w)) for a in ["", *letters]}
        near = [x for x in near - {w} if x in vocabulary]
        form = min(near, key=lambda x: (-vocabulary[x], x)) if near else None
        out[w] = (form if form and vocabulary[form] >= 5 * n else None, n, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, vocabulary.get(f)) for w, (f, n, k) in out.items()}


def check(docs, rows, **how):
    got = variants.variants(docs, **how).collect()
    assert len({r.word for r in got}) == len(got)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain(rows)


def spellings():
    """Chains of ever rarer spellings, ties, long words, accents, signs among the letters, hashed deletions."""
    rnd, rows = random.Random(6), []
    counts = {"banana": 5, "bananas": 30, "bananaz": 30, "bananass": 200, "orange": 25, "orangé": 5, "orangë": 125, "aaaaaaa": 9, "aaaaaa": 50,
              "aaaaaaaa": 300, "naïveté": 5, "naiveté": 40, "naivete": 5, "×÷×÷×÷": 6, "×÷×÷×": 50, "shorty": 4, "shorti": 100,
              "x" * 300: 6, "x" * 299: 40, "lonely" * 50: 7, "ÿÿÿÿÿÿ": 5, "ÿÿÿÿÿÀ": 26}
    for k in range(40):
        counts["".join(rnd.choice("abc") for _ in range(rnd.randint(6, 7)))] = rnd.randint(1, 60)
    every = [w for w, n in counts.items() for _ in range(n)]
    rnd.shuffle(every)
    for k in range(0, len(every), 6):
        rows.append((k, " ".join(w.upper() if w.isascii() and rnd.random() < 0.2 else w for w in every[k:k + 6]) + "1, é-a_bcdefg"))
    return rows + [(None, "bananas bananas"), (1, None), (2, ""), (3, "bananas"), (3, "bananas")]


@pytest.mark.parametrize("max_filter", [variants.MAX_FILTER, 16])
def test_spellings(spark, max_filter):
    """With 16 bytes of filter, the vocabulary takes several passes."""
    rows = spellings()
    check(spark.createDataFrame([(*r, "c", 1, "d") for r in rows], SCHEMA).repartition(3), rows, max_filter=max_filter)


def test_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(variants, "TASK_WORDS", 3)
    monkeypatch.setattr(variants, "EDITS", 50)
    rows = spellings()
    check(spark.createDataFrame([(*r, "c", 1, "d") for r in rows], SCHEMA).repartition(2), rows)


def test_corpus(docs, rows):
    check(docs, [r[:2] for r in rows])


def test_nothing(no_docs):
    assert variants.variants(no_docs).collect() == []
