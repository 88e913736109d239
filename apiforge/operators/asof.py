"""As-of lookup: for every probe row, the latest build row of the same key with
``build.seq < probe.seq``, one value column at a time (``last`` ignoring nulls).

Spark has no as-of join.  A single window over the key would put a hot key
(one file holding a third of all facts, one alias used a billion times) into
one task.  The order axis is therefore cut into blocks of ``block`` positions
and the lookup is done in two bounded parts:

1. inside the block: a window partitioned by ``(key, block)`` over probe and
   build rows, frame ``unboundedPreceding .. -1``;  a window group holds at
   most ``block`` positions of one key;
2. from earlier blocks: the last build row of each ``(key, block)`` (a hash
   aggregate with partial aggregation), carried forward by a window over the
   per-block summaries of one key (``#blocks`` rows, i.e. ``block`` times
   fewer than the rows of the key), joined to the probes on ``(key, block)``.

The answer is the in-block hit, else the carried value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def asof_last(probe: DataFrame, build: DataFrame, keys: list, values: list, *,
              seq: str = "seq", block: int = DEFAULT_BLOCK, max_seq: int | None = None) -> DataFrame:
    """``probe`` (keys, seq, ...) gets the columns ``values`` of ``build``
    (keys, seq, values...).  Each value column is looked up on its own, so a
    build row may fill only some of them (nulls are skipped).

    ``max_seq``: a known bound of ``seq`` (e.g. the largest visit position of
    any file, one cheap aggregate).  When everything fits in one block the
    carry from earlier blocks is left out of the plan: one window remains,
    whose groups are bounded by ``block`` anyway.
    """
    if max_seq is not None and max_seq < block:
        u = (probe.select("*", F.lit(0).alias("_side"))
             .unionByName(build.select(*keys, seq, *values, F.lit(1).alias("_side")),
                          allowMissingColumns=True))
        w = (Window.partitionBy(*keys).orderBy(F.col(seq), F.col("_side"))
             .rowsBetween(Window.unboundedPreceding, -1))
        return (u.select(*[c for c in probe.columns if c not in values], "_side",
                         *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
                 .where(F.col("_side") == 0).drop("_side"))
    blk = F.floor(F.col(seq) / F.lit(block)).cast("long").alias("_blk")
    p = probe.select("*", blk, F.lit(0).alias("_side"))
    b = build.select(*keys, seq, *values, blk, F.lit(1).alias("_side"))
    # 1. within the block (probe rows sort before build rows at an equal seq: strict <)
    u = p.unionByName(b, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, "_blk").orderBy(F.col(seq), F.col("_side"))
         .rowsBetween(Window.unboundedPreceding, -1))
    inside = u.select("*", *[F.last(v, ignorenulls=True).over(w).alias("_in_" + v) for v in values]) \
              .where(F.col("_side") == 0)
    # 2. carry from earlier blocks
    summary = b.groupBy(*keys, "_blk").agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(seq))).alias(v) for v in values])
    probe_blocks = p.select(*keys, "_blk").distinct()
    su = (probe_blocks.select(*keys, "_blk", F.lit(0).alias("_side"))
          .unionByName(summary.select(*keys, "_blk", *values, F.lit(1).alias("_side")),
                       allowMissingColumns=True))
    w2 = (Window.partitionBy(*keys).orderBy(F.col("_blk"), F.col("_side"))
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = (su.select(*keys, "_blk", "_side",
                       *[F.last(v, ignorenulls=True).over(w2).alias("_c_" + v) for v in values])
               .where(F.col("_side") == 0).drop("_side"))
    j = inside.join(carry, keys + ["_blk"], "left")
    out = j.select(*[c for c in probe.columns if c not in values],
                   *[F.coalesce(F.col("_in_" + v), F.col("_c_" + v)).alias(v) for v in values])
    return out
