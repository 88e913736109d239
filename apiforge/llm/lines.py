"""Operator 4 [native]: line dedup by prefix doubling over line-ID sequences.

All lines of the corpus, in the order of the documents' ids, form one sequence of
line IDs with borders between documents.  Round k of prefix doubling names the class of
the 2^k lines from each position by the smallest position of that class; round k + 1
pairs the names of a position and of the position 2^k further.  A class is a
longest-common-prefix interval of the suffix array at depth 2^k; positions whose
interval has one suffix only leave, so rounds shrink to what really repeats.  Any
run of m lines is identified by its length and the names of its first and its last 2^k
lines (2^k <= m < 2^(k+1)), which is the interval test at depth m.

A run counts if it has ``min_words`` words.  Every repeated run of that size is a union of
*shortest* such runs, those from each of its lines and those up to each of its
lines, so only these are tested: a shortest run that occurs at a smaller
position is a later copy and its lines are deleted.  The union of deleted runs is exactly the
union of the maximal ones.

Only DataFrame functions; line texts are not shuffled, and no key has to fit a task:
classes are hash aggregates joined back by salted keys.

Defined cases: a null text stays null; an empty text has one empty line; a run that repeats
itself at once ("x x x") keeps its first period; of repeated rows (same id and text) all
get the same result and count once; documents without id come first in the
order; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import assign_id_num
from ..session import shuffled, stage

MIN_WORDS, SALTS = 50, 16
WORD = r"[^\x20\x09-\x0D]+"


def line_table(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """A row per line: document (``_id, _th``), ``i``, ID (``_h1, _h2``) and the shortest run of
    ``min_words`` words from it (last line ``_to``) and up to it (first line ``_from``)."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"),
        F.posexplode_outer(F.split(text, "\n")).alias("i", "_line"))
    rows = rows.select("_id", "_th", "i", F.xxhash64("_line").alias("_h1"),
                       F.xxhash64(F.lit(1), F.reverse("_line")).alias("_h2"),
                       F.regexp_count("_line", F.lit(WORD)).cast("long").alias("_w"))
    rows = rows.repartition("_id", "_th").dropDuplicates(["_id", "_th", "i"])
    doc = Window.partitionBy("_id", "_th")
    rows = rows.withColumn("_upto", F.sum("_w").over(doc.orderBy("i")))
    # words up to a line, and where each line's own run has enough, meet on one axis
    at = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("_upto").alias("x")),
        F.struct(F.lit(1).alias("kind"), (F.col("_upto") - F.col("_w") + min_words).alias("x"))))
    both = rows.withColumn("_e", at).select("*", "_e.kind", "_e.x").drop("_e")
    axis = doc.orderBy("x")
    both = both.withColumn("_to", F.min(F.when(F.col("kind") == 0, F.col("i"))).over(
        axis.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    both = both.withColumn("_from", F.max(F.when(F.col("kind") == 1, F.col("i"))).over(
        axis.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    # kind 1 knows the run from its line, kind 0 the run up to its line
    return (both.groupBy("_id", "_th", "i", "_h1", "_h2")
                .agg(F.max(F.when(F.col("kind") == 1, F.col("_to"))).alias("_to"),
                     F.max(F.when(F.col("kind") == 0, F.col("_from"))).alias("_from")))


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a table of one row per key; a hot key's rows go to ``SALTS`` tasks."""
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("pos", F.lit(SALTS)).cast("int")).join(shuffled(copies), [*keys, "_salt"]).drop("_salt")


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``pos, name`` of the rows whose ``keys`` occur twice or more (name: smallest pos)."""
    classes = (rows.groupBy(*keys).agg(F.min("pos").alias("name"), F.count(F.lit(1)).alias("_n"))
                   .filter(F.col("_n") > 1).drop("_n"))
    return salted_join(rows, classes, keys).select("pos", "name")


def doubled(names: DataFrame, reach: int) -> DataFrame:
    """Names of twice the length, from the names of two positions ``reach`` lines apart.

    A pair that crosses a document's end is harmless: no run reaches over it.
    """
    after = names.select((F.col("pos") - reach).alias("pos"), F.col("name").alias("_then"))
    return named(names.withColumnRenamed("name", "_first").join(shuffled(after), "pos"), ["_first", "_then"])


def later_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                 min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _th, _runs``: per document its deleted runs of lines (first, behind last), merged."""
    table = stage(line_table(docs, id_col, text, min_words), "lines")
    # null ids sort first; the text's hash only orders documents that share an id
    lines = stage(assign_id_num(table, ["_id", "_th", "i"], name="pos"), "positions")
    names = stage(named(lines, ["_h1", "_h2"]), "names")
    ends = F.explode(F.array(
        F.struct(F.col("i").alias("a"), F.col("_to").alias("b")),
        F.struct(F.col("_from").alias("a"), F.col("i").alias("b"))))
    runs = (lines.join(shuffled(names.select("pos")), "pos", "left_semi")         # a run's own line must repeat
                 .select("_id", "_th", (F.col("pos") - F.col("i")).alias("_base"), ends.alias("_e"))
                 .select("_id", "_th", "_base", "_e.*").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
                 .distinct())
    runs = stage(runs.select("_id", "_th", "a", (F.col("_base") + F.col("a")).alias("pos"),
                             (F.col("b") - F.col("a") + 1).cast("long").alias("m")), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0
    rounds, reach = [names], 1
    while 2 * reach <= longest:
        rounds.append(stage(doubled(rounds[-1], reach), "names"))
        reach *= 2
    # the runs of all lengths meet their rounds' names in one pass, so the driver's plans do not multiply by the rounds
    of_round = [F.lit(k).alias("_round") for k in range(len(rounds))]
    names = reduce(DataFrame.union, [n.select(k, "pos", "name") for k, n in zip(of_round, rounds)])
    first = names.select("_round", "pos", F.col("name").alias("_r1"))
    last = names.select("_round", F.col("pos").alias("_p2"), F.col("name").alias("_r2"))
    fits = sum((F.col("m") >= 1 << k).cast("int") for k in range(1, len(rounds))) if len(rounds) > 1 else F.lit(0)
    reach = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_round"))
    here = (runs.withColumn("_round", fits).withColumn("_p2", F.col("pos") + F.col("m") - reach)
                .join(shuffled(first), ["_round", "pos"]).join(shuffled(last), ["_round", "_p2"]))
    here = stage(here.select("_id", "_th", "a", "pos", "m", "_r1", "_r2"), "ends")
    origin = here.groupBy("m", "_r1", "_r2").agg(F.min("pos").alias("_origin"))
    copies = (salted_join(here, origin, ["m", "_r1", "_r2"]).filter(F.col("pos") > F.col("_origin"))
              .select("_id", "_th", "a", (F.col("a") + F.col("m")).alias("b")))
    doc = Window.partitionBy("_id", "_th").orderBy("a", "b")
    merged = (copies.withColumn("_new", (F.col("a") > F.coalesce(
                        F.max("b").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
                    .withColumn("_k", F.sum("_new").over(doc))
                    .groupBy("_id", "_th", "_k").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    return merged.groupBy("_id", "_th").agg(F.collect_list(F.struct("a", "b")).alias("_runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted from the text, and ``n_lines``, ``n_deleted`` before it.

    Returns ``_doc`` (the row as it came), ``text``, ``n_lines`` and ``n_deleted``.
    """
    runs = later_copies(docs, id_col=id_col, text=text, min_words=min_words)
    r = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_k1"), F.xxhash64(text).alias("_k2"))
    r = r.join(runs, F.col("_k1").eqNullSafe(F.col("_id")) & (F.col("_k2") == F.col("_th")), "left")
    lines = F.split(F.col("_doc")[text], "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("_runs", lambda q: (i >= q["a"]) & (i < q["b"])))
    deleted = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, q: n + q["b"] - q["a"])
    return r.select("_doc", F.when(F.col("_runs").isNull(), F.col("_doc")[text]).otherwise(F.array_join(kept, "\n")).alias("text"),
                    F.greatest(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"))


def deduped_rows(docs: DataFrame, **how) -> DataFrame:
    """Per row: id, n_lines, n_deleted and the text that stays."""
    key = how.get("id_col", "doc_id")
    return dedup_lines(docs, **how).select(F.col("_doc")[key].alias(key), "n_lines", "n_deleted", "text")
