"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffled, stage


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that links ``a, b`` (a < b) lead to has no other link: their nodes ``a`` are then the smallest reachable."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("up")),
                                          F.struct(F.col("b").alias("v"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return not nodes.filter((F.col("up") > 0) & (F.col("n") > 1)).agg(F.count(F.lit(1))).first()[0]


def stars(links: DataFrame) -> DataFrame:
    """``a, b``: one link from every node ``b`` of links ``a, b`` to the smallest node reachable, if that is another.

    Every round is one written table, whose plan may work out the large star twice; the number of rounds grows
    with the logarithm of the longest chain.  Links that are stars need no further round.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .filter(F.col("a") < F.col("b")).distinct(), "links")
    while not _are_stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(shuffled(low), "a").filter(F.col("b") > F.col("a"))
                     .select(F.col("m").alias("a"), "b").filter(F.col("a") < F.col("b")).distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(shuffled(low), "b")
                      .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                                                F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
                      .select("e.*").filter(F.col("a") < F.col("b")).distinct())
        edges = stage(small, "stars")
    return edges


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all nodes of links ``a, b``."""
    edges = stars(links)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
