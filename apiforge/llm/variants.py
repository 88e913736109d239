"""Operator 13: spelling variants by Bloom-guided edit neighbourhoods.

1. Words are counted inside the tasks and added up by one hash aggregate.  The words that
   occur often enough are the vocabulary, staged once.
2. The vocabulary becomes one blocked Bloom filter per word length: a word's hash
   picks a block of 256 bits, and one bit in each of its eight lanes.  Blocks are ORed in Spark.
   One pass holds ``max_filter`` bytes of filter at most; a larger vocabulary is dealt to several
   passes by the words' hashes, so what is broadcast never grows past that bound.
3. Every word makes its neighbourhood: all deletions of one code point, and all replacements
   of one by a later one of the vocabulary's alphabet (an insertion is a deletion seen from the
   other word, a replacement by an earlier one a replacement seen from there).  Edits are hashes only,
   made from the word's own hash by one multiplication, and probe the filter of their length.
4. Only positives become strings and shuffle, to an exact join with the vocabulary
   that removes false positives.  A pair of near words comes out once.
5. A word's form is its near word of largest count where that is ``ratio`` times its own;
   roots follow forms by pointer doubling (counts grow by ``ratio`` with each step, so chains are short).

Nothing is skewed by frequency: after step 1 a word is one row whatever its count, and a word
has at most (length + 1) * alphabet near words.

Defined cases: a null or empty text has no words; a null id writes as an empty text in the
hashed key; rows that repeat are counted each; ties take the smallest word in code-point order; an empty
table gives an empty result; other columns are not read; words of any length take part, and
an edit is only made where the vocabulary has another word of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stage

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
BITS_PER_WORD, MAX_FILTER = 12, 32 << 20
#: Distinct words a task holds before it hands its counts on, and edits hashed at a time.
TASK_WORDS, EDITS = 200_000, 1 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def thinned(doc_id, run: str) -> str:
    """The run with a code point deleted if 199 divides the hash of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 199:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                spelled=thinned) -> DataFrame:
    """``word, n``: how often each word of ``least_chars`` code points or more occurs.

    ``spelled(id, run)`` says how a document spells a lower-cased run of letters.
    """
    ship_package(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # bytes.lower touches A-Z only
                here = Counter(RUN.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                for run, n in here.items():
                    if len(run) >= least_chars:
                        word = spelled(i, run)
                        if len(word) >= least_chars:
                            seen[word] += n
                if len(seen) >= TASK_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=schema)
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=schema)

    rows = docs.select(F.col(id_col), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def by_length(words: list[str]):
    """``indices, code points`` (a row per word) of each length in ``words``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for m in np.unique(lengths):
        at = np.flatnonzero(lengths == m)
        flat = "".join(words[i] for i in at).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(flat, np.uint32).reshape(len(at), m).astype(np.uint64)


def weights(m: int) -> np.ndarray:
    """An odd multiplier per position."""
    return _mixed(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """Two bits of a block's ``k``-th long, one in each half."""
    low = hashes & np.uint64(0xFFFFFFFF)
    one, two = (((low * _LANES[2 * k + j] & np.uint64(0xFFFFFFFF)) >> np.uint64(27)) for j in (0, 1))
    return (np.uint64(1) << one) | (np.uint64(1) << (two + np.uint64(32)))


def blocks_for(n: int) -> int:
    return max(1, -(-n * BITS_PER_WORD // 256))


def filters(words: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """A filter (blocks x 4 longs) per length of ``words``; ``sizes`` has the number of words of a length."""
    def bits(batches):
        for b in batches:
            ws = b.column(0).to_pylist()
            for at, points in by_length(ws):
                m = points.shape[1]
                h = _mixed((points * weights(m)).sum(1, dtype=np.uint64) + np.uint64(m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), m, np.int32)), pa.array(block_of(h, blocks_for(sizes[m]))),
                     *(pa.array(lane(h, k).view(np.int64)) for k in range(4))], names=["m", "block", "l0", "l1", "l2", "l3"])

    rows = (words.select("word").mapInArrow(bits, "m int, block long, l0 long, l1 long, l2 long, l3 long")
                 .groupBy("m", "block").agg(*(F.bit_or(f"l{k}").alias(f"l{k}") for k in range(4))))
    table = rows.toArrow()                                  # max_filter bytes of blocks at most
    m, block = table["m"].to_numpy(), table["block"].to_numpy()
    lanes = np.stack([table[f"l{k}"].to_numpy().view(np.uint64) for k in range(4)], 1)
    out = {}
    for x in np.unique(m):
        out[int(x)] = np.zeros((blocks_for(sizes[int(x)]), 4), np.uint64)
        out[int(x)][block[m == x]] = lanes[m == x]
    return out


def hits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter may hold."""
    at = np.arange(len(hashes))
    for k in range(4):
        want = lane(hashes[at], k)
        at = at[table[block_of(hashes[at], len(table)), k] & want == want]
    return at


def edits(points: np.ndarray, shards: dict, sizes: dict[int, int], alphabet: np.ndarray):
    """``word, position, code point`` (0: deleted) of the edits that a filter may hold."""
    n, m = points.shape
    w = weights(m)
    terms = points * w
    whole = terms.sum(1, dtype=np.uint64)
    if m - 1 in shards:
        shorter = np.zeros_like(points)
        shorter[:, 1:] = points[:, 1:] * w[:-1]             # behind the deleted one every code point moves up
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        after = shorter.sum(1, dtype=np.uint64)[:, None] - np.cumsum(shorter, 1, dtype=np.uint64)
        first = np.ones(points.shape, bool)                 # of equal neighbours the first stands for all
        first[:, 1:] = points[:, 1:] != points[:, :-1]
        i, p = np.nonzero(first)
        found = hits(shards[m - 1], _mixed((before + after)[i, p] + np.uint64(m - 1)))
        yield i[found], p[found], np.zeros(len(found), np.uint64)
    if m in shards and sizes[m] > 1:
        for p in range(m):
            h = whole[:, None] + (alphabet[None, :] - points[:, p, None]) * w[p]
            i, a = np.nonzero(alphabet[None, :] > points[:, p, None])
            found = hits(shards[m], _mixed(h[i, a] + np.uint64(m)))
            yield i[found], np.full(len(found), p), alphabet[a[found]]


def near_pairs(vocabulary: DataFrame, *, max_filter: int = MAX_FILTER) -> DataFrame:
    """``a, a_n, b, b_n``: each two words of ``vocabulary(word, n)`` one edit apart, once."""
    spark = vocabulary.sparkSession
    ship_package(spark)
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()   # at most the characters of RUN
    alphabet = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint64)
    rows = vocabulary.groupBy(F.char_length("word").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length
    sizes, total = {r["m"]: r["n"] for r in rows}, sum(r["n"] for r in rows)
    passes = max(1, -(-total * BITS_PER_WORD // (8 * max_filter)))
    found = None
    for k in range(passes):
        part = vocabulary if passes == 1 else vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(passes)) == k)
        here = {r["m"]: r["n"] for r in part.groupBy(F.char_length("word").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
        shards = spark.sparkContext.broadcast(filters(part, here))

        def probe(batches, shards=shards):
            table = shards.value
            for b in batches:
                words, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
                for at, points in by_length(words):
                    step = max(1, EDITS // (points.shape[1] * (1 + len(alphabet))))
                    for lo in range(0, len(at), step):
                        for i, p, c in edits(points[lo:lo + step], table, sizes, alphabet):
                            where = at[lo + i]
                            made = [words[x][:y] + (chr(z) if z else "") + words[x][y + 1:]
                                    for x, y, z in zip(where.tolist(), p.tolist(), c.tolist())]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([words[x] for x in where], pa.string()), pa.array(counts[where], pa.int64()),
                                 pa.array(made, pa.string())], names=["a", "a_n", "b"])

        positives = vocabulary.select("word", "n").mapInArrow(probe, "a string, a_n long, b string")
        exact = positives.join(part.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
        exact = stage(exact.select("a", "a_n", "b", "b_n"), "near-pairs")
        found = exact if found is None else found.union(exact)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the last form, by pointer doubling."""
    step = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(step.join(further, "root", "left")
                          .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        step = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return step


def variants(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, spelled=thinned, max_filter: int = MAX_FILTER) -> DataFrame:
    """Per word: ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    vocabulary = stage(word_counts(docs, id_col=id_col, text=text, least_chars=least_chars, spelled=spelled)
                       .filter(F.col("n") >= least_count), "vocabulary")
    pairs = near_pairs(vocabulary, max_filter=max_filter)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))
    given = F.col("near_n") >= ratio * F.col("n")
    rows = stage(rows.select("word", "n", "n_near", F.when(given, F.col("near")).alias("form"),
                             F.when(given, F.col("near_n")).alias("form_n")), "forms")
    last = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
