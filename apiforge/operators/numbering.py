"""B2: dense global numbering in a given order without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Instead the rows are range-partitioned and sorted once and written, together
with the partition id and the position inside it, to a staged table.  Counts
and rows are both read from that table, so they always describe the same
partitions; the counts (one row per partition, so bounded by the partition count,
not by the data) become offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def assign_id_num(df: DataFrame, order_cols: list, *, name: str = "id_num",
                  start: int = 0) -> DataFrame:
    """Number rows 0.. (plus ``start``) in ``order_cols`` order.

    ``order_cols`` should define a total order (unique), as file order does;
    ties are numbered next to each other in an unspecified order.  The input is
    read twice (once to sample range bounds): stage it first if it is costly.
    """
    mid = F.monotonically_increasing_id()
    s = stage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.shiftright(mid, 33))
                .withColumn("_pos", mid.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a window over it is a few thousand rows at most
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(name, F.col("_off") + F.col("_pos") + F.lit(start))
             .drop("_pid", "_pos", "_off"))
