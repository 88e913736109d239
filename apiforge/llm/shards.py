"""Operator 3: sharding by longest-processing-time scheduling.

Equal texts are one group and stay together.  Groups go, largest first, to the
shard that holds the least bytes (a heap; ties to the smaller shard number).
Groups of equal size are interchangeable, so the schedule is worked out on the
table (group bytes, number of groups): its length is at most the square root of
twice the bytes of the corpus (k different sizes add up to at least k * k / 2), which
bounds what the driver and the broadcast hold; a run of equal groups costs a
search for the level they fill up to, not a step per group.  Groups and rows get
their ranks by distributed sorts.

Defined cases: a null text is an empty one (size 1); rows that repeat are rows of
one group, each with a slot of its own; an empty table gives an empty result; one group
larger than a fair share makes its shard larger, since it may not be split;
other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import assign_id_num
from ..session import ship_package, stage


def take_equal(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of ``size`` each shard takes; adds them to ``loads``."""
    def below(level: int) -> list[int]:
        return [max(0, -(-(level - x) // size)) for x in loads]

    took = [0] * len(loads)
    if n > len(loads):                       # as many as surely fit below a level, at once
        lo, hi = min(loads), min(loads) + size * (n + 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid - 1)
        took = below(lo)
    heap = [(x + size * k, j) for j, (x, k) in enumerate(zip(loads, took))]
    heapq.heapify(heap)
    for _ in range(n - sum(took)):           # the rest one by one
        load, j = heap[0]
        heapq.heapreplace(heap, (load + size, j))
        took[j] += 1
    for j, k in enumerate(took):
        loads[j] += size * k
    return took


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first group number, shard), for groups numbered from the largest size down."""
    loads, firsts, to, at = [0] * shards, [], [], 0
    for k in np.argsort(-sizes, kind="stable"):
        for j, n in enumerate(take_equal(loads, int(sizes[k]), int(counts[k]))):
            if n:
                firsts.append(at)
                to.append(j)
                at += n
    return np.array(firsts, np.int64), np.array(to, np.int32)


def assign_shards(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Per row: id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("_key")), "sizes")
    groups = stage(rows.groupBy("_key", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("_bytes"))
                       .select("_key", "size", "_bytes"), "groups")
    classes = groups.groupBy("_bytes").count().toArrow()          # bounded, see above
    runs = spark.sparkContext.broadcast(
        schedule(classes["_bytes"].to_numpy(), classes["count"].to_numpy(), shards))

    def place(batches):
        firsts, to = runs.value
        for b in batches:
            k = np.searchsorted(firsts, b.column(2).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to[k], pa.int32())],
                                             names=["_key", "size", "shard"])

    numbered = assign_id_num(groups, [F.col("_bytes").desc(), F.col("_key")], name="_n")
    placed = numbered.select("_key", "size", "_n").mapInArrow(place, "_key binary, size long, shard int")
    # a hot group is one key on this side only: adaptive execution splits its rows
    sharded = stage(rows.join(placed, ["_key", "size"]), "sharded")
    slots = assign_id_num(sharded, ["shard", "_id", "_key"], name="_n")
    starts = slots.groupBy("shard").agg(F.min("_n").alias("_first"))      # a row per shard
    return (slots.join(F.broadcast(starts), "shard")
                 .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("_n") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
