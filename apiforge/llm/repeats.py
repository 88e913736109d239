"""Operator 12: repeated substrings of words by recompression.

1. Texts that occur several times are one class; a class of two or more is repeated as a whole, and
   one row of it stands for its words in all that follows.
2. Recompression: a text is the sequence of its words' names.  Rounds name maximal runs of one
   symbol, and pairs of a left and a right symbol (a coin by symbol and round says which it is).
   A name is a hash of what it stands for, so the same run or pair has one name in every task
   and no dictionary travels.  Equal substrings get equal symbols in their interior: at each border a
   round can disturb the outermost run, or the outermost symbol whose coin points outwards, and nothing else.
   So every window knows which symbols of the last round it determines by its own words.
3. Spark counts the names over the corpus.  A window that determines a symbol which occurs once
   occurs once; only windows whose determined symbols are all shared (or that determine none, as
   inside long runs) go on.
4. Those are verified: windows get names of 128 bits, Spark counts them, and a window named
   twice is repeated.  Its words go.

Shuffled are symbols (about a sixth of the words), the names of suspect windows, and the texts
that hold any; a Bloom filter of fixed size keeps the other texts in place.  Symbols and windows that
hold over 1/2000 of all rows are joined by broadcast (fewer than 2000 can), so a passage in a
third of all documents loads no task.  A document is the unit of a Python worker's memory;
names need 8 bytes a word and round.

Defined cases: a null text has no words and an empty kept text; texts shorter than a window keep all;
overlapping repeats inside one text count (a run of one word longer than a window loses all of it);
rows that repeat are copies of each other, with or without an id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .caches import only
from .sieve import attach, maybe_in, semi_by_count

WINDOW, ROUNDS = 35, "rpppppp"                # r: runs, p: pairs
#: Words parsed at a time.
WORDS_AT_ONCE = 400_000
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class WordNames(dict):
    """16 bytes of hash by word, kept per worker."""

    def __missing__(self, word: bytes) -> bytes:
        h = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def names_of(words: list[bytes]) -> np.ndarray:
    """Two 64-bit names a word (rows of two)."""
    known = only("word names", WordNames)
    return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Parse:
    """Symbols of the last round over several texts at once.

    ``symbols``; ``at``: each symbol's first word, and behind the last one the number of words;
    ``left[p]``, ``right[p]``: where the symbols begin (end) that words from p on (up to p) determine.
    """

    def __init__(self, names: np.ndarray, text_of: np.ndarray, rounds: str):
        n = len(names)
        self.symbols, self.at, self.of = names, np.arange(n + 1), text_of
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        for k, kind in enumerate(rounds):
            self._runs() if kind == "r" else self._pairs(k)

    def _step(self, after: np.ndarray, before: np.ndarray) -> None:
        """A border at a symbol's start moves to ``after``, one at its end to ``before``."""
        n = len(self.left)
        moved = np.arange(n)
        moved[self.at[:-1]] = after
        self.left = moved[self.left]
        moved = np.arange(n)
        moved[self.at[1:]] = before
        self.right = moved[self.right]

    def _runs(self) -> None:
        s, of = self.symbols, self.of
        begins = np.ones(len(s), bool)
        begins[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(s)))
        run = np.cumsum(begins) - 1
        at = np.append(self.at[:-1][first], self.at[-1])
        self._step(at[1:][run], at[:-1][run])               # the outermost run may go on outside
        self.symbols = np.where(length > 1, mixed(s[first] * _M2 + length.astype(np.uint64)), s[first])
        self.at, self.of = at, of[first]

    def _pairs(self, k: int) -> None:
        s, of = self.symbols, self.of
        salt = np.uint64((k + 1) * 0xA0761D6478BD642F % (1 << 64))
        left = (mixed(s ^ salt) >> np.uint64(63)).astype(bool)
        # a left symbol cannot be joined from its left, nor a right one from its right
        self._step(np.where(left, self.at[:-1], self.at[1:]), np.where(left, self.at[:-1], self.at[1:]))
        joined = np.zeros(len(s), bool)
        joined[:-1] = left[:-1] & ~left[1:] & (of[1:] == of[:-1])
        stays = np.ones(len(s), bool)
        stays[1:] = ~joined[:-1]
        out = s.copy()
        j = np.flatnonzero(joined)
        out[j] = mixed(mixed(s[j]) * _M2 + s[j + 1] + salt)
        self.symbols, self.of = out[stays], of[stays]
        self.at = np.append(self.at[:-1][stays], self.at[-1])

    def windows(self, ends: np.ndarray, window: int):
        """``start, a, b``: all windows inside a text, and which symbols [a, b) they determine (a >= b: none).

        ``ends``: where each word's text ends.
        """
        p = np.flatnonzero(np.arange(len(ends)) + window <= ends)
        number = np.zeros(len(self.left), np.int64)
        number[self.at] = np.arange(len(self.at))
        return p, number[self.left[p]], number[self.right[p + window]]


def chunks(rows, words_at_once: int):
    """Lists of ``rows`` (their words last) of about so many words."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[-1])
        if n >= words_at_once:
            yield held
            held, n = [], 0
    if held:
        yield held


def parsed(words: list[list[bytes]], rounds: str):
    """Names, first word of each text (and behind the last), end by word, parse."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(lengths)])
    names = names_of([w for ws in words for w in ws])
    of = np.repeat(np.arange(len(words)), lengths)
    return names, first, first[1:][of], Parse(names[:, 0].copy(), of, rounds)


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``_id, _t`` and ``_key``, 16 bytes that stand for the text."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), F.unhex(F.md5(F.col(text))).alias("_key"))


def symbol_rows(rows: DataFrame, window: int, rounds: str) -> DataFrame:
    """``_key, rid, syms, need, blind`` of ``rows(_key, _t)`` that have a window.

    ``need[i]``: how many symbols from the i-th one on some window determines (0: none begins there);
    ``blind``: some window determines no symbol.
    """
    longs, kinds = pa.list_(pa.int64()), "_key binary, syms array<long>, need binary, blind boolean"

    def parse(batches):
        for b in batches:
            every = zip(b.column(0).to_pylist(), map(word_list, b.column(1).to_pylist()))
            for some in chunks((r for r in every if len(r[1]) >= window), WORDS_AT_ONCE):
                _, first, ends, got = parsed([r[1] for r in some], rounds)
                p, a, z = got.windows(ends, window)
                sees = a < z
                need = np.zeros(len(got.symbols), np.uint8)
                i, n = a[sees], np.minimum((z - a)[sees], 255)
                if len(i):
                    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    need[i[begin]] = np.minimum.reduceat(n, begin)
                cut = np.searchsorted(got.at, first)        # first symbol of each text
                blind = np.zeros(len(some), bool)
                blind[np.searchsorted(first, p[~sees], "right") - 1] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(got.symbols.view(np.int64))).cast(longs),
                     pa.array([need[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), pa.array(blind)],
                    names=["_key", "syms", "need", "blind"])

    return rows.select("_key", "_t").mapInArrow(parse, kinds).withColumn("rid", F.monotonically_increasing_id())


def suspects(symbols: DataFrame) -> DataFrame:
    """``_key, rid, shared`` (symbols that occur elsewhere too) of the texts with a window that may repeat."""
    each = symbols.select("rid", F.posexplode("syms").alias("i", "sym"))
    counts = stage(symbols.select(F.explode("syms").alias("sym")).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
                          .filter(F.col("n") > 1), "shared-symbols")
    shared = semi_by_count(each, counts, ["sym"]).groupBy("rid").agg(F.collect_list("i").alias("shared"))

    def judge(batches):
        for b in batches:
            keep = []
            for need, blind, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                n = np.frombuffer(need, np.uint8).astype(np.int64)
                lone = np.ones(len(n) + 1, np.int64)
                lone[shared or []] = 0
                upto = np.concatenate([[0], np.cumsum(lone[:-1])])
                i = np.flatnonzero(n)
                keep.append(blind or bool((upto[i + n[i]] == upto[i]).any()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 4)], names=["_key", "rid", "shared"]).filter(pa.array(keep))

    whole = symbols.select("_key", "rid", "need", "blind").join(shared, "rid", "left").select("_key", "rid", "need", "blind", "shared")
    return whole.mapInArrow(judge, "_key binary, rid long, shared array<int>")


def window_rows(rows: DataFrame, window: int, rounds: str) -> DataFrame:
    """``rid, s, w1, w2``: starts and names of the suspect windows of ``rows(rid, shared, _t)``."""
    def name(batches):
        for b in batches:
            every = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(word_list, b.column(2).to_pylist()))
            for some in chunks(every, WORDS_AT_ONCE):
                names, first, ends, got = parsed([r[2] for r in some], rounds)
                cut = np.searchsorted(got.at, first)
                lone = np.ones(len(got.symbols), np.int64)
                for c, (_, shared, _) in zip(cut, some):
                    lone[c + np.asarray(shared or [], np.int64)] = 0
                upto = np.concatenate([[0], np.cumsum(lone)])
                p, a, z = got.windows(ends, window)
                p = p[upto[np.maximum(a, z)] == upto[a]]
                acc = np.zeros((len(p), 2), np.uint64)
                for k in range(window):                     # a polynomial in the words' names, in both lanes
                    acc = acc * _M2 + names[p + k]
                acc = mixed(acc).view(np.int64)
                text = np.searchsorted(first, p, "right") - 1
                rid = np.fromiter((r[0] for r in some), np.int64, len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[text]), pa.array((p - first[text]).astype(np.int32)), pa.array(acc[:, 0]), pa.array(acc[:, 1])],
                    names=["rid", "s", "w1", "w2"])

    return rows.select("rid", "shared", "_t").mapInArrow(name, "rid long, s int, w1 long, w2 long")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   rounds: str = ROUNDS) -> DataFrame:
    """``_key, n, spans`` (staged) of the texts with words to remove.

    ``n`` rows have the text; ``spans`` are the covered words [a, b), null where n > 1 (all of them, if a window fits).
    """
    ship_package(docs.sparkSession)
    rows = keyed(docs, id_col, text).filter(F.col("_t").isNotNull())
    copied = stage(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_of")).filter(F.col("n") > 1), "copied")
    one = attach(rows, copied, "_key", "n").filter(F.col("n").isNull() | F.col("_id").eqNullSafe(F.col("_of")))
    symbols = stage(symbol_rows(one, window, rounds), "symbols")
    suspect = stage(suspects(symbols), "suspects")
    held = maybe_in(rows.select("_key", "_t"), suspect, "_key").filter("_maybe").drop("_maybe").join(suspect, "_key")
    windows = stage(window_rows(held, window, rounds), "windows")
    counts = stage(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "shared-windows")
    found = semi_by_count(windows, counts, ["w1", "w2"]).select("rid", "s").distinct()
    doc = Window.partitionBy("rid").orderBy("s")
    spans = (found.withColumn("_new", (F.col("s") > F.coalesce(F.lag("s").over(doc) + window, F.lit(-1))).cast("int"))
                  .withColumn("_k", F.sum("_new").over(doc))
                  .groupBy("rid", "_k").agg(F.struct(F.min("s").alias("a"), (F.max("s") + window).alias("b")).alias("span"))
                  .groupBy("rid").agg(F.sort_array(F.collect_list("span")).alias("spans")))
    whole = copied.select("_key", "n", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    parts = spans.join(suspect.select("rid", "_key"), "rid").select("_key", "spans").join(copied, "_key", "left_anti")
    return stage(whole.unionByName(parts.select("_key", F.lit(1).cast("long").alias("n"), "spans")), "spans")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                    rounds: str = ROUNDS) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and ``kept_text`` (words joined by one space)."""
    spans = repeated_spans(docs, id_col=id_col, text=text, window=window, rounds=rounds)
    rows = keyed(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, n, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = word_list(t)
                stays = words
                if n is not None and n > 1:
                    stays = [] if len(words) >= window else words
                elif spans:
                    stays, done = [], 0
                    for x in spans:
                        stays += words[done:x["a"]]
                        done = x["b"]
                    stays += words[done:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stays))
                kept.append(b" ".join(stays).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["_id", "n_words", "n_removed", "kept_text"])

    return (attach(rows, spans, "_key", "n").select("_id", "_t", "n", "spans")
            .mapInArrow(remove, f"_id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("_id", id_col))
