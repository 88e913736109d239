"""Operator 5: quality classifier on random-indexing word vectors.

1. *Word vectors* (all documents).  Words fall into ``buckets`` by hash; each
   bucket owns a sparse ternary index vector.  A word's context vector is the sum
   of the index vectors of the words up to two places away, over the whole
   corpus.  Every task adds up one matrix of fixed size (integers, so the sum does not
   depend on the order); Spark sums the matrices per bucket.
2. *Document vectors*.  Mean and spread of the word vectors over the whole text, and how
   alike neighbouring words are.
3. *Network*.  Two layers in numpy, fitted on a bounded sample of labelled rows
   (``max_train``, by hash of the id, of the rows the caller allows), then a
   temperature fitted on a part of the sample that the network has not seen.
4. *Scores* (all documents), map-side with the broadcast model (fixed size).

Labels, language, source and id never enter a score.

Defined cases: a null or empty text has a zero vector and gets the score of that;
documents without label are scored alike; several labels of one id count by
their majority (a tie counts as 1), null labels do not count; with no label at
all, or an empty table, every score is 0.5; repeated rows get equal scores; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .caches import only

BUCKETS, DIM, NONZERO, WINDOW = 8_192, 32, 4, 2
MAX_TRAIN, HIDDEN, EPOCHS, SEED = 20_000, 32, 40, 17
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall
_FLUSH = 500_000
#: Texts scored at a time.
TEXTS = 512


class Words(dict):
    """Bucket ids (int32 bytes) of a blank-delimited word, kept per worker."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> bytes:
        ids = []
        for t in _TOKEN(word):
            ids.append(1 + zlib.crc32(t.lower().encode("utf-8", "replace")) % (self.buckets - 1))
            if len(t) > 1 and t.isupper():
                ids.append(1 + zlib.crc32(b"\0capitals") % (self.buckets - 1))
        out = np.array(ids, np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").split())), np.int32)


def _words(buckets: int) -> Words:
    return only(("words", buckets), lambda: Words(buckets))


def index_vectors(buckets: int = BUCKETS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero parts; bucket 0 (text borders) has none."""
    rng = np.random.RandomState(SEED)
    places = rng.randint(0, dim, (buckets, NONZERO))
    signs = rng.choice([-1.0, 1.0], (buckets, NONZERO))
    signs[0] = 0
    return places, signs


def add_contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the neighbours' index vectors of every id to its row of ``total`` (flat)."""
    dim = total.size // places.shape[0]
    for gap in range(1, WINDOW + 1):
        for word, near in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
            row = word.astype(np.int64) * dim
            for k in range(NONZERO):
                total += np.bincount(row + places[near, k], signs[near, k], total.size)


def context_counts(docs: DataFrame, text: str = "text", *, buckets: int = BUCKETS,
                   dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(context vectors, word counts) by bucket over all documents."""
    def add(batches):
        words, (places, signs) = _words(buckets), index_vectors(buckets, dim)
        total, seen = np.zeros(buckets * dim), np.zeros(buckets, np.int64)
        border, held, size = np.zeros(WINDOW, np.int32), [], 0

        def flush():
            ids = np.concatenate(held) if held else border
            add_contexts(total, ids, places, signs)
            seen[:] += np.bincount(ids, minlength=buckets)
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                ids = words.ids(t)
                held += [ids, border]
                size += len(ids) + len(border)
                if size >= _FLUSH:
                    flush()
                    size = 0
        flush()
        at = np.flatnonzero(seen)
        at = at[at > 0]
        rows = total.reshape(buckets, dim)[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(seen[at]), *(pa.array(rows[:, i].copy()) for i in range(dim))],
            names=["bucket", "n", *(f"v{i}" for i in range(dim))])

    cols = [f"v{i}" for i in range(dim)]
    parts = docs.select(F.col(text).alias("t")).mapInArrow(
        add, "bucket int, n long, " + ", ".join(f"{c} long" for c in cols))
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in cols))
    vectors, n = np.zeros((buckets, dim)), np.zeros(buckets)
    got = sums.toArrow()                       # one row per bucket: fixed size
    at = got["bucket"].to_numpy()
    n[at] = got["n"].to_numpy()
    for i, c in enumerate(cols):
        vectors[at, i] = got[c].to_numpy()
    return vectors, n


def word_vectors(contexts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Context vectors per occurrence, centred on the corpus mean, of length 1."""
    per = contexts / np.maximum(n, 1)[:, None]
    mean = (per * n[:, None]).sum(0) / max(n.sum(), 1)
    v = np.where(n[:, None] > 0, per - mean, 0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def width(dim: int) -> int:
    """Length of a document vector."""
    return 2 * dim + 4


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, the length of the mean, how alike
    neighbours and next-but-one words are, and how many words it has."""
    dim = vectors.shape[1]
    out = np.zeros(width(dim))
    if len(ids):
        sums, squares, alike = np.zeros(dim), np.zeros(dim), np.zeros(2)
        for a in range(0, len(ids), 65_536):            # a long text needs no long matrix
            v = vectors[ids[a:a + 65_538]]
            own = v[:65_536]
            sums += own.sum(0, dtype=np.float64)
            squares += (own * own).sum(0, dtype=np.float64)
            for gap in (1, 2):
                w = v[gap:gap + len(own)]
                alike[gap - 1] += np.einsum("ij,ij->", v[:len(w)], w)
        mean = sums / len(ids)
        out[:dim], out[dim:2 * dim] = mean, np.sqrt(np.maximum(squares / len(ids) - mean * mean, 0))
        out[2 * dim:] = np.sqrt(mean @ mean), alike[0] / len(ids), alike[1] / len(ids), np.log1p(len(ids))
    return out


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> dict:
    """Two-layer network (Adam, weight decay) and its temperature."""
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = x - mean
    z /= std
    rng = np.random.RandomState(SEED)
    order = rng.permutation(len(z))
    unseen, seen = order[:len(z) // 6], order[len(z) // 6:]
    w = [rng.randn(z.shape[1], hidden) / np.sqrt(z.shape[1]), np.zeros(hidden),
         rng.randn(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        mixed = rng.permutation(seen)
        for a in range(0, len(mixed), 256):
            q = z[mixed[a:a + 256]]
            h = np.tanh(q @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[mixed[a:a + 256]]) / len(q)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [q.T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    model = {"mean": mean, "std": std, "w": w, "temperature": 1.0}
    if len(unseen):
        logits = logit(model, x[unseen])

        def loss(t: float) -> float:
            s = logits / t
            return float(np.mean(np.logaddexp(0, s) - y[unseen] * s))

        model["temperature"] = float(min(np.exp(np.linspace(-2, 2, 81)), key=loss))
    return model


def logit(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["w"]
    return np.tanh((x - model["mean"]) / model["std"] @ w[0] + w[1]) @ w[2] + w[3]


def majority(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """One 0/1 label per id."""
    return (labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
                  .groupBy(F.col(id_col).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y")))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text",
        label: str = "quality", max_train: int = MAX_TRAIN, buckets: int = BUCKETS,
        dim: int = DIM) -> dict | None:
    """Word vectors of all ``docs`` and a network for ``labels`` (the rows learnt from).

    At most ``max_train`` labelled ids (the smallest hashes) are looked up, so the
    broadcast of ids and the collected vectors are bounded by that parameter.
    """
    ship_package(docs.sparkSession)
    vectors = word_vectors(*context_counts(docs, text, buckets=buckets, dim=dim))
    size, shared = width(dim), docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        words = _words(buckets)
        for b in batches:
            x = np.array([pooled(words.ids(t), shared.value) for t in b.column(2).to_pylist()]).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["_id", "_y", "x"])

    chosen = majority(labels, id_col, label).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    kind = docs.schema[id_col].dataType.simpleString()
    got = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("t"))
               .join(F.broadcast(chosen), "_id").select("_id", "_y", "t")
               .mapInArrow(pool, f"_id {kind}, _y int, x array<double>").toArrow())
    if not got.num_rows:
        return None
    order = np.argsort(got["_id"].to_numpy(zero_copy_only=False), kind="stable")
    y = got["_y"].to_numpy().astype(np.float64)[order]
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, size)[order]     # no Python object a number
    del got
    pa.default_memory_pool().release_unused()        # the driver keeps one copy of the vectors
    return train(x, y) | {"vectors": vectors}


def score(docs: DataFrame, model: dict | None, *, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` but the text, and ``score`` (0 to 1)."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in docs.columns if c != text]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def rate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, m = _words(buckets), shared.value
        size = width(m["vectors"].shape[1])
        for column in columns:
            scores = [np.zeros(0)]
            for a in range(0, len(column), TEXTS):
                x = np.array([pooled(words.ids(t), m["vectors"]) for t in column.slice(a, TEXTS).to_pylist()]).reshape(-1, size)
                scores.append(1 / (1 + np.exp(-np.clip(logit(m, x) / m["temperature"], -500, 500))))
            yield pa.array(np.concatenate(scores))

    # only the texts go to Python; not deterministic to the planner, so a filter on the score runs it once
    rated = F.arrow_udf(rate, "double").asNondeterministic()
    return docs.select("*", rated(F.col(text)).alias("score")).select(*keep, "score")


def in_fold(id_col, fold: int = 1, folds: int = 3):
    """Whether crc32 of the id's text falls into ``fold`` (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """id, held_out, score and predicted; learns from the labels outside the held-out fold."""
    model = fit(docs, labels.filter(~in_fold(id_col)), id_col=id_col, text=text, label=label)
    rows = score(docs.select(id_col, text), model, text=text)
    return rows.select(id_col, in_fold(id_col).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
