"""Operators 7 and 9 against the tokenizers library, packing against its rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from apiforge.llm import packing, token_counts, tokens

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text():
    c, rnd = tokens.Coder("byte_bpe_50k.json", lambda i: i), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "'", "!", "é", "中", " ", "​", "\u0085", "\x1c", "1", "23",
             "<|endoftext|>", "᠎", " ", "ß", "🙂", "\r\n", "　", "don't", "\0", "word,", "Ünd.", "x|", "*%&"]
    for _ in range(5_000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [i for v in c.values_of(s) for i in v] == ids(s), repr(s)


def test_full_caches_and_fixed_tier(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 3)
    c = tokens.Coder("byte_bpe_50k.json", len, {"red": len(ids(" red"))})
    for s in ("a red cat, a dog; a bird. red!", "one two three four five six seven eight, nine"):
        assert sum(c.values_of(s)) == len(ids(s))
    assert "red" in c and len(c) <= 5


def test_a_word_that_comes_once_is_one_entry():
    c, words = tokens.Coder("byte_bpe_50k.json", packing.as_bytes), [f"w{'aeiou'[i % 5] * (i % 7 + 1)}{chr(97 + i // 35)}x" for i in range(350)]
    text = "a " + " ".join(f"{w}," for w in words)
    for entries in (len(words), 2 * len(words), 2 * len(words)):     # the second time its signs are kept too
        assert c.total(text, b"".join) == packing.as_bytes(ids(text))
        assert len(c) == entries


@pytest.mark.parametrize("sample, table", [(2_000, 32_768), (1, 1)])
def test_counts(docs, rows, sample, table):
    got = token_counts.count_tokens(docs, sample_docs=sample, table_size=table)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 512) for r in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_counts_of_nothing(no_docs):
    assert token_counts.count_tokens(no_docs).collect() == []


def check_packed(got, rows, capacity):
    seqs, whole = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append(r)
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(ids(r[1]) + [0])
    for doc, copies in texts.items():
        want = Counter()
        for t in copies:
            first = (len(t) - 1) % capacity + 1
            cuts = [0, *range(first, len(t) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[k, a, b - a, zlib.crc32(np.array(t[a:b], "<u4").tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in whole[doc]) == want
    return len(seqs)


def test_packing(docs, rows):
    got = packing.pack_documents(docs, capacity=64, groups=8).collect()
    n = check_packed(got, rows, 64)
    total = sum(r.length for r in got)
    assert total / 64 <= n <= total / 64 * 1.05 + 1


def test_packing_returns_the_ids(docs, rows):
    got = packing.pack_documents(docs, with_ids=True).collect()
    check_packed(got, rows, 2048)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 16, 40):
        for _ in range(25):
            hist = rng.integers(0, int(rng.integers(1, 30)), capacity + 1).astype(np.int64)
            hist[rng.random(capacity + 1) < 0.3] = 0
            hist[0] = 0
            placed, n = packing.plan(hist, capacity, int(rng.integers(1, 12)), int(rng.integers(1, 9)))
            bins, seen = defaultdict(list), set()
            for length, rank, count, seq, per, offset in zip(*(placed[f].tolist() for f in packing._FIELDS)):
                for j in range(count):
                    bins[seq + j // per].append((offset + j % per * length, length))
                    assert (length, rank + j) not in seen
                    seen.add((length, rank + j))
            assert len(seen) == hist.sum() and len(bins) == n
            for places in bins.values():
                end = 0
                for offset, length in sorted(places):
                    assert offset == end
                    end += length
                assert end <= capacity


def test_plan_is_close_to_the_bound():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.2, 0.8, 60_000).astype(int) + 1, 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    assert packing.plan(hist)[1] <= 1.005 * lengths.sum() / 2048
