"""Joins with large texts or hot keys that move only what they must.

``maybe_in`` is a Bloom filter of a fixed number of bits whatever the number of keys: with more
keys it lets more rows through and never loses one.  ``split_hot`` rests on a count: fewer
than ``HOT_SHARE`` keys can hold more than one ``HOT_SHARE``-th of all rows each, so
those are broadcast, and no key left in the shuffled join is larger than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS, HOT_SHARE = 1 << 17, 2_000


def _block(hashed):
    return hashed.bitwiseAND(BLOCKS - 1)


def _or_bits(hashed):
    """Three bits of a block of 64."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 17 + 6 * k).bitwiseAND(63).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def maybe_in(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``_maybe``: false if their ``columns`` are surely not among the ``keys``."""
    filled = (keys.select(F.xxhash64(*columns).alias("_h"))
                  .groupBy(_block(F.col("_h")).alias("_block")).agg(F.bit_or(_or_bits(F.col("_h"))).alias("_set")))
    hashed = rows.withColumn("_h", F.xxhash64(*columns))
    found = hashed.withColumn("_block", _block(F.col("_h"))).join(F.broadcast(filled), "_block", "left")   # BLOCKS rows at most
    want = _or_bits(F.col("_h"))
    return (found.withColumn("_maybe", F.coalesce(F.col("_set").bitwiseAND(want) == want, F.lit(False)))
                 .drop("_h", "_block", "_set"))


def split_hot(counts: DataFrame, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """The keys of ``counts`` (staged) that hold over one ``HOT_SHARE``-th of all its rows, and the others."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_SHARE > total
    return counts.filter(hot), counts.filter(~hot)


def semi_by_count(rows: DataFrame, counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` whose ``keys`` stand in ``counts`` (a row per key with its number of rows)."""
    hot, cold = (t.select(*keys) for t in split_hot(counts, n))
    few = F.broadcast(hot)
    return rows.join(few, keys, "left_semi").union(rows.join(few, keys, "left_anti").join(cold, keys, "left_semi"))


def attach(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (staged; a row per ``key``; ``n``: how many rows have the key).

    Rows surely without a partner, and those of hot keys, are not shuffled.
    """
    hot, cold = split_hot(table, n)
    given = [c for c in table.columns if c != key]
    seen = maybe_in(rows, table, key).join(F.broadcast(hot), key, "left")
    here = ~F.col("_maybe") | F.col(n).isNotNull()
    stay = seen.filter(here).drop("_maybe")
    move = seen.filter(~here).drop("_maybe", *given).join(cold, key, "left")
    return stay.unionByName(move)
