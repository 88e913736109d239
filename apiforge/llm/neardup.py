"""Operator 10: MinHash near-duplicates by a multi-index Hamming join.

1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature of
   ``HASHES`` b-bit MinHash values (b = 16).  Equal word sequences collapse into one class.
2. Signatures are split into chunks of ``CHUNK`` values.  By the pigeonhole principle two
   signatures that differ in at most ``chunks * (ERRORS + 1) - 1`` values have a chunk with
   at most ``ERRORS`` errors; the allowed errors are enumerated by leaving out every choice of
   ``ERRORS`` values, so such a pair always shares a key.
3. A bucket (a key's classes) first compares all its classes with one pivot, so the work is
   linear however large it is.  Links found merge classes into components.  What is
   left are pairs of *different* components in a bucket of three or more, after a second
   pivot.  These are decided where they meet, block by block: by set
   sizes, the distance of longer signatures and, for classes that resemble their bucket's pivot (crowds of
   copies that differ from each other a little too much), exactly: a class is written as what
   the pivot's set lacks or has too much, and two such differences give the
   intersection of the two sets.  A crowd is dealt to a task for each pair of its parts; tasks hand on only links that
   join components, so what comes out does not grow with the square of a crowd.  No bucket is capped.
4. Every candidate whose sets were not compared exactly in step 3 is confirmed on the full shingle sets.

At similarity s a pair is missed with probability (1 - P(a chunk has at most one
error)) ** chunks: 2e-6 at 0.85 and 4e-5 at 0.8; the distance tests add under 2e-6.

Classes, not ids, are what is linked: texts of equal word sequences share a number of their own, so several
texts of one id are several documents, whatever the order of the rows.

Defined cases: a text without words, or null, has an empty set and is linked with
nothing (its own component); fewer words than a shingle count as one shingle; every row is a
document: rows of one id are linked only by their texts, and each gets the smallest id that its own text
reaches; rows without id are not linked, have no component and are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, shuffled, stage
from .caches import only
from .components import stars

HASHES, CHUNK, ERRORS = 24, 4, 1
LANES = 3
#: One-bit values of the longer signature that pairs of crowded buckets are tested with, 63 to a long.
FINE, FINE_LANES = 252, 63
#: Rows of a bucket that one join settles; those of larger ones (crowds) are dealt to parts of ``CROWD`` rows, and a
#: task compares two parts.
FEW, CROWD = 64, 512
#: Up to so many ids their list is broadcast to filter texts (64 MB in memory, 8 bytes of key and 24 of row in tables of
#: up to twice that); beyond, joined.  No other join is a broadcast, whatever Spark takes a table's size for.
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.RandomState(10)
_MULTIPLY, _FINE_MULTIPLY = ((_RNG.randint(0, 2 ** 62, n).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
                             for n in (HASHES, FINE))
_ADD, _FINE_ADD = (_RNG.randint(0, 2 ** 62, n).astype(np.uint64) for n in (HASHES, FINE))


class WordHashes(dict):
    """8 bytes of hash by word, kept per worker."""

    def __missing__(self, word: bytes) -> bytes:
        h = hashlib.blake2b(word, digest_size=8).digest()
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def word_list(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lowered (bytes.lower and bytes.split touch ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _sequence(words: list[bytes]) -> bytes | None:
    """16 bytes that stand for a word sequence (none: null)."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    known = only("word hashes", WordHashes)
    h = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):                    # polynomial in the words, mixed after each
        out = (out ^ h[i:len(h) - k + 1 + i]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _packed(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray, bits: int, lanes: int) -> np.ndarray:
    """MinHash values of ``bits`` bits (of the smallest of every multiply-add hash), ``lanes`` to a long."""
    best = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 16_384):
        best = np.minimum(best, (hashes[a:a + 16_384, None] * multiply + add).min(0))
    best = (((best ^ (best >> np.uint64(31))) * _ODD) >> np.uint64(64 - bits)).astype(np.int64).reshape(-1, lanes)
    return sum(best[:, k] << (bits * k) for k in range(lanes))


def signature(hashes: np.ndarray) -> np.ndarray:
    return _packed(hashes, _MULTIPLY, _ADD, 16, LANES)


def fine_signature(hashes: np.ndarray) -> np.ndarray:
    return _packed(hashes, _FINE_MULTIPLY, _FINE_ADD, 1, FINE_LANES)


def value(sig, i: int):
    """The ``i``-th value of a signature column."""
    return F.shiftright(F.get(sig, i // LANES), 16 * (i % LANES)).bitwiseAND(0xFFFF)


def signed(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``doc_id, _key`` (of the word sequence, null without words), ``n_shingles, _sig``."""
    def sign(batches):
        for b in batches:
            keys, n, sigs = [], [], []
            for t in b.column(1).to_pylist():
                w = word_list(t)
                s = shingles(w, width)
                keys.append(_sequence(w))
                n.append(len(s))
                sigs.append(signature(s) if w else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "_key", "n_shingles", "_sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        sign, "doc_id long, _key binary, n_shingles long, _sig array<long>")


def sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``id, _set, _fine``: full shingle sets and longer signatures of the classes ``wanted(id, _doc, _key)`` (one
    row each), from the texts of the documents ``_doc`` whose words are those of ``_key``."""
    longs = pa.list_(pa.int64())

    def build(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_list(t)
                s = shingles(w, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([_sequence(w)], pa.binary()), pa.array([s.view(np.int64)], longs),
                     pa.array([fine_signature(s)], longs)], names=["_doc", "_key", "_set", "_fine"])

    ids = wanted.select("_doc")
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else shuffled(ids)
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text).alias("t")).join(ids, "_doc", "left_semi")
    built = rows.mapInArrow(build, "_doc long, _key binary, _set array<long>, _fine array<long>")
    # a class is one pair of document and key: repeats go and ids come by one shuffle of the sets
    return built.dropDuplicates(["_doc", "_key"]).join(shuffled(wanted), ["_doc", "_key"]).select("id", "_set", "_fine")


def distance(a, b):
    """Number of differing values of two signatures, all values of a long at once."""
    low, top = 0x7FFF7FFF7FFF, 0x800080008000
    out = F.lit(0)
    for j in range(HASHES // LANES):
        z = F.get(a, j).bitwiseXOR(F.get(b, j))
        # adding all low bits carries into a value's top bit unless its low bits are 0
        out = out + F.bit_count((z.bitwiseAND(low) + low).bitwiseOR(z).bitwiseAND(top))
    return out


def fine_distance(a, b):
    return sum(F.bit_count(F.get(a, j).bitwiseXOR(F.get(b, j))) for j in range(FINE // FINE_LANES))


def farthest(similarity: float, values: int = HASHES, bits: int = 16, miss: float = 1e-6) -> int:
    """Largest distance a pair of ``similarity`` has but with probability ``miss``."""
    q, tail = (1 - similarity) * (1 - 0.5 ** bits), 0.0
    for d in range(values, -1, -1):
        tail += comb(values, d) * q ** d * (1 - q) ** (values - d)
        if tail > miss:
            return d
    return 0


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``b, key, id``: every chunk with every value left out (ERRORS = 1), numbered by ``b``."""
    keys = []
    for c in range(0, HASHES, CHUNK):
        for out in range(c, c + CHUNK):
            kept = [value("_sig", i) for i in range(c, c + CHUNK) if i != out]
            keys.append(F.xxhash64(F.lit(out), *kept))
    return classes.select(F.posexplode(F.array(*keys)).alias("b", "key"), "id")


def first_buckets(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The number of the first bucket that ``own`` shares with each row of ``values`` (-1: none).

    A chunk without errors shares all its buckets, one with an error the bucket that leaves it out.
    """
    apart = (values != own).reshape(len(values), -1, CHUNK)
    near = apart.sum(2) <= ERRORS
    chunk = near.argmax(1)
    return np.where(near.any(1), CHUNK * chunk + apart[np.arange(len(values)), chunk].argmax(1), -1)


def few_links(opened: DataFrame, test: _Links) -> DataFrame:
    """``a, b``: links across components in buckets of ``FEW`` rows at most, by one join."""
    side = ["_c", "_n", "_np", "_d", "_minus", "_plus", "_fine"]
    x = opened.select("key", F.col("id").alias("a"), *(F.col(c).alias(c + "a") for c in side))
    y = opened.select("key", F.col("id").alias("b"), *(F.col(c).alias(c + "b") for c in side))
    sizes = F.col("_na"), F.col("_nb")
    known = F.col("_minusa").isNotNull() & F.col("_minusb").isNotNull()
    most = (F.col("_npa") - F.greatest(F.size("_minusa"), F.size("_minusb"))
            + F.least(F.size("_plusa"), F.size("_plusb")))
    common = (F.col("_npa") - F.size(F.array_union("_minusa", "_minusb"))
              + F.size(F.array_intersect("_plusa", "_plusb")))
    # cheap bounds first; the exact test is a function of its own, which keeps the others' code small
    may = (test.alike(F.least(*sizes), *sizes) & (F.abs(F.col("_da") - F.col("_db")) <= 1 - test.num / test.den + 1e-9)
           & (~known | test.alike(most, *sizes)) & (fine_distance("_finea", "_fineb") <= test.fine_far)
           & (~known | F.exists(F.array(F.lit(True)), lambda t: t & test.alike(common, *sizes))))
    return (x.join(shuffled(y), (x["key"] == y["key"]) & (F.col("_ca") < F.col("_cb")) & may)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def crowd_links(opened: DataFrame, test: _Links) -> DataFrame:
    """``a, b, known``: links across components among the ``_m`` rows of each bucket of ``opened``, found exactly
    (``known``) or to be confirmed.

    A bucket's rows are dealt to a task for each pair of its parts of ``CROWD`` rows.  A task joins components as it
    goes, so it hands on fewer exact links than it has rows; a pair is tested in the first bucket that it shares only
    (where one of the two is that bucket's pivot, it has been tested).
    """
    num, den, fine_far, apart = test.num, test.den, test.fine_far, 1 - test.num / test.den + 1e-9

    def rows_of(column) -> tuple[np.ndarray, np.ndarray]:
        """Values of a list column in a row, and where each list ends (null: empty)."""
        lists = column.combine_chunks()
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        return lists.flatten().to_numpy(), np.cumsum(lengths)

    def common(flag, at, ends):
        upto = np.concatenate([[0], np.cumsum(flag[at])])
        return upto[ends] - upto[np.concatenate([[0], ends[:-1]])]

    def find(key, table):
        m, cell = table.num_rows, (key[1].as_py(), key[2].as_py())
        ids, part, bucket = (table[c].to_numpy() for c in ("id", "_part", "b"))
        n, of, d = (table[c].to_numpy() for c in ("_n", "_np", "_d"))
        root = np.unique(table["_c"].to_numpy(), return_inverse=True)[1]
        fine = np.array(table["_fine"].to_pylist(), np.int64)
        values = np.array(table["_sig"].to_pylist(), np.int64)
        values = np.stack([(values[:, i // LANES] >> (16 * (i % LANES))) & 0xFFFF for i in range(HASHES)], 1)
        known = ~table["_minus"].is_null().combine_chunks().to_numpy(zero_copy_only=False)
        (minus, minus_ends), (plus, plus_ends) = rows_of(table["_minus"]), rows_of(table["_plus"])
        dense = np.unique(np.concatenate([minus, plus]), return_inverse=True)[1]
        minus, plus, flag = dense[:len(minus)], dense[len(minus):], np.zeros(len(dense) + 1, np.int64)
        sizes = np.diff(minus_ends, prepend=0)
        out: tuple[list, list, list] = ([], [], [])
        for i in range(m):
            j = np.flatnonzero(root != root[i])
            j = j[j > i] if cell[0] == cell[1] else j[part[j] != part[i]]
            if cell[0] != cell[1] and part[i] != cell[0]:
                continue
            least = np.minimum(n[j], n[i])
            j = j[(den * least >= num * (n[j] + n[i] - least)) & (np.abs(d[j] - d[i]) <= apart)]
            j = j[np.bitwise_count(fine[j] ^ fine[i]).sum(1) <= fine_far] if len(j) else j
            j = j[first_buckets(values[j], values[i]) == bucket[i]] if len(j) else j
            if not len(j):
                continue
            exact = known[j] & known[i]
            for k in j[~exact]:
                out[0].append(ids[i])
                out[1].append(ids[k])
                out[2].append(False)
            if exact.any():
                begin = lambda ends: ends[i - 1] if i else 0
                counts = []
                for at, ends in ((minus, minus_ends), (plus, plus_ends)):
                    own = at[begin(ends):ends[i]]
                    flag[own] = 1
                    counts.append(common(flag, at, ends))
                    flag[own] = 0
                both = of - (sizes + sizes[i] - counts[0]) + counts[1]
                for k in j[exact]:
                    if root[k] != root[i] and den * both[k] >= num * (n[i] + n[k] - both[k]):
                        out[0].append(ids[i])
                        out[1].append(ids[k])
                        out[2].append(True)
                        root[root == root[k]] = root[i]
        a, b = np.array(out[0], np.int64), np.array(out[1], np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "known": pa.array(out[2], pa.bool_())})

    own = F.col("_part")
    cells = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda k: F.struct(F.least(k, own).alias("_row"), F.greatest(k, own).alias("_col")))
    dealt = (opened.withColumn("_g", F.ceil(F.col("_m") / CROWD).cast("int")).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_g")).cast("int"))
                   .withColumn("_cell", F.explode(cells)).select("*", "_cell._row", "_cell._col").drop("_cell"))
    return dealt.groupBy("key", "_row", "_col").applyInArrow(find, "a long, b long, known boolean")


class _Links:
    """Candidates in, confirmed links (staged) out."""

    def __init__(self, docs, classes, id_col, text, width, num, den):
        self.docs, self.sigs, self.how = docs, classes.select("id", "_sig"), (id_col, text, width)
        self.classes = classes.select("id", "_doc", "_key")
        self.num, self.den = num, den
        self.far, self.fine_far = farthest(num / den), farthest(num / den, FINE, 1)

    def near(self, pairs: DataFrame) -> DataFrame:
        a = self.sigs.select(F.col("id").alias("a"), F.col("_sig").alias("_sa"))
        b = self.sigs.select(F.col("id").alias("b"), F.col("_sig").alias("_sb"))
        return (pairs.join(shuffled(a), "a").join(shuffled(b), "b").filter(distance("_sa", "_sb") <= self.far).select("a", "b"))

    def sets(self, ids: DataFrame) -> DataFrame:
        # written, as both joins with the texts read it
        wanted = stage(self.classes.join(shuffled(ids.distinct()), "id", "left_semi"), "wanted")
        return stage(sets(self.docs, wanted, *self.how), "sets")

    def alike(self, common, one, other):
        """Whether sets of these sizes with ``common`` members in common are linked."""
        return self.den * common >= self.num * (one + other - common)

    def differences(self, members: DataFrame) -> DataFrame:
        """``id, _p, _n, _np, _d, _minus, _plus``: sets of ``members(id, _p)`` as differences from their
        pivot's set (null where these are longer than the pivot's set), both sizes and the Jaccard distance."""
        pairs = stage(members.select("id", "_p").distinct(), "members-of")
        full = self.sets(pairs.select("id").union(pairs.select(F.col("_p").alias("id"))))
        both = (pairs.join(shuffled(full), "id")
                     .join(shuffled(full.select(F.col("id").alias("_p"), F.col("_set").alias("_of"))), "_p"))
        minus, plus = F.array_except("_of", "_set"), F.array_except("_set", "_of")
        both = both.select("id", "_p", "_fine", F.size("_set").alias("_n"), F.size("_of").alias("_np"),
                           minus.alias("_minus"), plus.alias("_plus"))
        short = F.size("_minus") + F.size("_plus") <= F.col("_np")
        apart = (F.size("_minus") + F.size("_plus")) / (F.col("_np") + F.size("_plus"))
        return stage(both.select("id", "_p", "_fine", "_n", "_np", apart.alias("_d"), *(F.when(short, F.col(c)).alias(c) for c in ("_minus", "_plus"))),
                     "differences")

    def confirm(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs that are links; None if there are no pairs."""
        pairs = stage(pairs, "candidates")
        if pairs.isEmpty():
            return None
        full = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        both = (pairs.join(shuffled(full.select(F.col("id").alias("a"), F.col("_set").alias("_x"))), "a")
                     .join(shuffled(full.select(F.col("id").alias("b"), F.col("_set").alias("_y"))), "b"))
        both = both.withColumn("_n", F.size(F.array_intersect("_x", "_y")))
        return stage(both.filter(self.alike(F.col("_n"), F.size("_x"), F.size("_y"))).select("a", "b"), "confirmed")


def linked(docs: DataFrame, classes: DataFrame, *, id_col: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """``id, _root`` of the ``classes`` (``id, _doc, _key, _sig``) that links join to a smaller one, the smallest
    that any links reach.

    The driver plans every job, so components go on from those of the round before instead of from all
    links, and what several jobs read is written.
    """
    test = _Links(docs, classes, id_col, text, width, num, den)
    rows = bucket_rows(classes)
    first = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_p")).filter(F.col("_n") > 1)
    members = stage(rows.join(shuffled(first), "key"), "members")
    pairs = members.filter(F.col("id") > F.col("_p")).select(F.col("_p").alias("a"), F.col("id").alias("b"))
    found = test.confirm(test.near(pairs.distinct()))
    if found is None:                                      # no class resembles another
        return classes.select("id", F.col("id").alias("_root")).limit(0)
    found = stars(found)
    crowd = members.filter(F.col("_n") > 2)                # buckets of two are settled
    for last in (False, True):
        labelled = crowd.join(shuffled(found.select(F.col("b").alias("id"), F.col("a").alias("_root"))), "id", "left") \
                        .withColumn("_c", F.coalesce("_root", "id")).drop("_root")
        mixed = (labelled.groupBy("key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"),
                                             F.max(F.struct("_c", "id")).alias("_top"))
                         .filter(F.col("_lo") < F.col("_hi")).select("key", F.col("_top.id").alias("_q"),
                                                                    F.col("_hi").alias("_qc")))
        opened = stage(labelled.join(shuffled(mixed), "key"), "open")
        if opened.isEmpty():                               # every bucket is one component
            break
        known = None
        if not last:                                       # second pivot: the last class of the last component
            pairs = opened.filter((F.col("_c") < F.col("_qc")) & (F.col("id") != F.col("_p"))).select(
                F.least("id", "_q").alias("a"), F.greatest("id", "_q").alias("b"))
            more = test.near(pairs.distinct())
        else:                                              # the rest: every pair across components
            # the differences are taken from a class of the bucket's largest component; a bucket has its first pivot
            # once, which is settled, and ``_m`` other rows
            central = (opened.groupBy("key", "_c").agg(F.count(F.lit(1)).alias("_k"), F.min("id").alias("_i"))
                             .groupBy("key").agg(F.max(F.struct("_k", "_i"))["_i"].alias("_p"), (F.sum("_k") - 1).alias("_m")))
            opened = stage(opened.filter(F.col("id") != F.col("_p")).select("b", "key", "id", "_c").join(shuffled(central), "key"), "rest")
            differences = shuffled(test.differences(opened))
            few = opened.filter(F.col("_m") <= FEW).join(differences, ["id", "_p"])
            crowds = opened.filter(F.col("_m") > FEW)
            more = few_links(few, test)
            if not crowds.isEmpty():
                known = stage(crowd_links(crowds.join(differences, ["id", "_p"]).join(shuffled(test.sigs), "id"), test), "crowd-links")
                more = more.union(known.filter(~F.col("known")).select("a", "b"))
                known = known.filter("known").select("a", "b")
            more = more.distinct()
        more = [x for x in (known, test.confirm(more)) if x is not None]
        if more:
            found = stars(reduce(DataFrame.union, more, found))
    return found.select(F.col("b").alias("id"), F.col("a").alias("_root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3,
                    num: int = 85, den: int = 100) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept; links where ``den * intersection >= num * union``."""
    ship_package(docs.sparkSession)
    rows = stage(signed(docs, id_col, text, width), "signed")
    classes = stage(rows.filter(F.col("_key").isNotNull() & F.col("doc_id").isNotNull())
                        .groupBy("_key").agg(F.min("doc_id").alias("_doc"), F.first("_sig").alias("_sig"))
                        .withColumn("id", F.monotonically_increasing_id()), "classes")
    found = linked(docs, classes, id_col=id_col, text=text, width=width, num=num, den=den)
    of = (classes.select("_key", "id", "_doc").join(shuffled(found), "id", "left")
                 .withColumn("component", F.coalesce("_root", "id")))
    named = of.join(shuffled(of.groupBy("component").agg(F.min("_doc").alias("_c"))), "component").select("_key", "_c")
    out = rows.select("doc_id", "n_shingles", "_key").join(shuffled(named), "_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return (out.withColumn("component_id", own)
               .select(F.col("doc_id").alias(id_col), "n_shingles", "component_id",
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
