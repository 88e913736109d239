"""Operator 6: mixing sources to target weights by Pareto order sampling.

1. Sizes (words) add up per source; targets share a multiple of all sizes by weight
   and stop at ``most`` times their source's size, the excess going to the
   others by weight: a water level, found by windows over the table of sources.
2. target / source size is the expected number of copies.  Its whole part is
   allocated to every document; the rest is the inclusion probability p.
3. Pareto order sampling: documents are ranked by (u / (1 - u)) / (p / (1 - p)), with u a
   uniform number from a hash of the id, and the sample is the prefix whose words come
   nearest to what the whole copies leave open.  ``odds`` multiplies a document's inclusion
   odds, for unequal probabilities within a source.
4. The cut of each source is found in two steps, so a hot source never meets in one
   task: sums over ``SLICES`` slices of the order, then the ranks inside the one slice
   that holds the cut.  The plan has a row per source; applying it is map-side.

Defined cases: a null text has size 0; a null source is a source of its own (the
last); sources of size 0 have target 0; rows of one source with the same id and rank are
taken together; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SLICES, SEED = 4_096, "mix"
#: Up to so many sources their table is broadcast (under 8 MB); beyond, joined by source.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column) -> Column:
    """A number strictly between 0 and 1 from the id (52 bits of an md5)."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` with its ``target`` (one row per source in and out)."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (F.row_number().over(ranked) - 1) % len(weights) + 1))
    s = s.withColumn("_cap", (most * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_level", F.max(left / open_weight).over(everything))
    return s.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_level")).alias("target"))


def with_source(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    t = table.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(t) if small else t, rows["source"].eqNullSafe(F.col("_s"))).drop("_s")


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``_slice`` and ``_rank`` (the Pareto rank) to rows with ``_u``, ``_odds`` and ``_p``."""
    x = F.col("_u") / (1 - F.col("_u")) / F.col("_odds")
    return (rows.withColumn("_slice", F.least(F.floor(x / (1 + x) * SLICES), F.lit(SLICES - 1)).cast("int"))
                .withColumn("_rank", F.when(F.col("_p") > 0, x / (F.col("_p") / (1 - F.col("_p"))))))


def prepared(docs: DataFrame, id_col: str, text: str, source: str, odds: Column | None) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       uniform(F.col(id_col)).alias("_u"),
                       (F.lit(1.0) if odds is None else odds.cast("double")).alias("_odds"))


def plan(rows: DataFrame, **how) -> tuple[DataFrame, bool]:
    """Per source: source_size, target, whole copies, p and the cut (slice, rank, id).

    ``rows`` as made by ``prepared``, read three times (stage it).  The flag says
    whether the table is small enough to broadcast.
    """
    sizes = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    small = sizes.count() <= BROADCAST_SOURCES
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = (sizes.withColumn("_whole", F.floor(copies).cast("long"))
                  .withColumn("_p", copies - F.floor(copies))
                  .withColumn("_open", F.col("target") - F.col("_whole") * F.col("source_size")))
    cut = ranked(with_source(rows, table.select("source", "_p", "_open"), small).filter(F.col("_p") > 0))
    slices = cut.groupBy("source", "_slice", "_open").agg(F.sum("size").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_slice"))
    last = (slices.withColumn("_before", upto - F.col("_n")).filter(F.col("_before") <= F.col("_open"))
                  .groupBy("source").agg(F.max(F.struct("_slice", "_before")).alias("_l"))
                  .select("source", F.col("_l._slice").alias("_cut_slice"), F.col("_l._before").alias("_before")))
    last = stage(last, "slices")
    inside = with_source(cut, last, small).filter(F.col("_slice") == F.col("_cut_slice"))
    ties = inside.groupBy("source", "_rank", "_id", "_open", "_before").agg(F.sum("size").alias("_n"))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy("source").orderBy("_rank", "_id")
                                                    .rowsBetween(Window.unboundedPreceding, 0))
    # a document belongs to the prefix if its middle does: the nearer of both ends
    chosen = (ties.withColumn("_end", end).filter(2 * F.col("_end") - F.col("_n") <= 2 * F.col("_open"))
                  .groupBy("source").agg(F.max(F.struct("_rank", "_id")).alias("_cut")))
    out = table.join(last.withColumnRenamed("source", "_s1"), F.col("source").eqNullSafe(F.col("_s1")), "left") \
               .join(chosen.withColumnRenamed("source", "_s2"), F.col("source").eqNullSafe(F.col("_s2")), "left")
    return stage(out.select("source", "source_size", "target", "_whole", "_p", "_cut_slice", "_cut"), "mix"), small


def copies(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the columns of the plan and ``_copies``."""
    r = ranked(with_source(rows, table, small))
    at = F.struct(F.col("_rank"), F.col("_id"))
    extra = (F.col("_slice") < F.col("_cut_slice")) | ((F.col("_slice") == F.col("_cut_slice")) & (at <= F.col("_cut")))
    return r.withColumn("_copies", F.col("_whole") + F.coalesce((extra & (F.col("_p") > 0)).cast("long"), F.lit(0)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source",
        odds: Column | None = None, **how) -> DataFrame:
    """Per row: id, size, source_size, target and taken (words times copies)."""
    rows = stage(prepared(docs, id_col, text, source, odds), "words")
    out = copies(rows, *plan(rows, **how))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    odds: Column | None = None, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (text is not shuffled)."""
    names = docs.columns
    rows = prepared(docs, id_col, text, source, odds)
    table, small = plan(stage(rows, "words"), **how)
    whole = docs.select(F.struct(*names).alias("_doc"), F.col(id_col).alias("_id"), F.col(source).alias("source"),
                        uniform(F.col(id_col)).alias("_u"),
                        (F.lit(1.0) if odds is None else odds.cast("double")).alias("_odds"))
    taken = copies(whole, table, small).filter(F.col("_copies") > 0)
    return (taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
                 .select("_doc.*"))
