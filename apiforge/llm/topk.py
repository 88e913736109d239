"""Operator 2: exact top-k search with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each segment the mean and the deviation (the
norm of what the mean leaves) are kept.  For two vectors the inner product is
at most the sum over segments of ``length * mean * mean + deviation * deviation``
(Cauchy-Schwarz), which is the same as a lower bound on their distance; finer
segments give tighter bounds.  Queries and rows meet in blocks:

1. a query's scores in one block give a score that its k-th best reaches at least;
2. in every block bounds are taken coarse to fine, each level only for pairs that the
   level before let through; survivors get the exact integer score;
3. a block hands on at most k rows a query, and only those that reach the
   threshold; the best k of these are the result.

Defined cases: rows whose id or vector is null, or whose vector holds a null or a
non-finite number, take no part; vectors of another length than the query's are no candidates;
repeated rows (same id and vector) count once, rows of the query's id are its own;
scores beyond a long are cut off at its ends; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage

LEVELS = (1, 4, 16)
ROW_BLOCK, QUERY_BLOCK = 8_192, 1_024
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``id, dim, v``: floor(scale * x) as doubles (whole numbers, exact), once per (id, v)."""
    def convert(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x is None or any(y is None for y in x):
                    continue
                v = np.floor(np.array(x, np.float64) * scale)
                if np.isfinite(v).all():
                    ids.append(i)
                    dims.append(len(v))
                    out.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()),
                                              pa.array(out, pa.binary())], names=["id", "dim", "v"])

    return (rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x"))
                .mapInArrow(convert, "id long, dim int, v binary").dropDuplicates(["id", "v"]))


def summaries(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose dot products bound the inner products of the rows of ``m``."""
    parts = np.array_split(m, min(segments, max(1, m.shape[1])), axis=1)
    means = [p.sum(1) / math.sqrt(max(1, p.shape[1])) for p in parts]
    rests = [np.sqrt(np.maximum((p * p).sum(1) - a * a, 0)) for p, a in zip(parts, means)]
    return np.stack(means + rests, axis=1)


def scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``m`` with ``q`` (cut off at a long's ends)."""
    if not m.size:
        return np.zeros(len(m), np.int64)
    if np.abs(m).max() * max(1.0, np.abs(q).max()) * m.shape[1] < 2.0 ** 53:
        return (m @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in m]
    return np.array([min(max(s, _LOW), _HIGH) for s in exact], np.int64)


def best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -s.astype(object) if len(s) and s.min() == _LOW else -s))[:k]


def block_search(queries: dict, rows: dict, k: int) -> tuple[list, list, list]:
    """(query id, row id, score) of up to k best rows a query that reach its threshold."""
    fine = [(summaries(rows["m"], n), summaries(queries["m"], n)) for n in LEVELS]
    out: tuple[list, list, list] = ([], [], [])
    for j, (qid, q) in enumerate(zip(queries["id"], queries["m"])):
        at = np.flatnonzero(rows["id"] != qid)
        least = queries["least"][j]
        if least is not None:
            for of_rows, of_queries in fine:
                bound = of_rows[at] @ of_queries[j]
                at = at[bound + 1e-9 * np.abs(bound) + 1.0 >= least]
        s = scores(rows["m"][at], q)
        if least is not None:
            at, s = at[s >= least], s[s >= least]
        top = best(rows["id"][at], s, k)
        out[0].extend([int(qid)] * len(top))
        out[1].extend(rows["id"][at[top]].tolist())
        out[2].extend(s[top].tolist())
    return out


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, dim)


def search_blocks(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Queries (``id, dim, v, least, qb, cb``) against rows (``id, dim, v, qb, cb``) of the same block pair."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            found = block_search({"id": left["id"].to_numpy(), "m": _matrix(left, dim), "least": left["least"].to_pylist()},
                                 {"id": right["id"].to_numpy(), "m": _matrix(right, dim)}, k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "cb"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score long")


def exact_top_k(rows: DataFrame, is_query, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
                scale: int = 64, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` takes the id column and marks the queries."""
    ship_package(rows.sparkSession)
    whole = stage(whole_vectors(rows, id_col, vector, scale), "vectors")
    queries = whole.filter(is_query(F.col("id"))).select(*(F.col(c).alias(c) for c in whole.columns))
    n_rows, n_queries = whole.count(), queries.count()
    rb, qb = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    whole = whole.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(rb)).cast("int"))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(qb)).cast("int"))
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb")
    first = search_blocks(queries.withColumn("least", F.lit(None).cast("long")).withColumn("cb", F.lit(0)),
                          whole.filter(F.col("cb") == 0).select("id", "dim", "v", "cb", every_query_block), k)
    least = (first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") == k).select(F.col("query_id").alias("id"), "least"))
    spread = (queries.join(least, "id", "left")
                     .select(*(F.col(c).alias(c) for c in ("id", "dim", "v", "least", "qb")), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("cb")))
    found = search_blocks(spread, whole.select("id", "dim", "v", "cb", every_query_block), k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
