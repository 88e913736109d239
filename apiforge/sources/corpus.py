"""Corpus assembly (A3, B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_corpus(tasks: DataFrame, *, order_col: str | None = None) -> DataFrame:
    """A3: ``task_id -> code = code_prompt || canonical_solution``.

    A task id listed twice keeps its last row (by ``order_col``, e.g. the line
    number of the input file); ``max_by`` with map-side partial aggregation.
    """
    code = F.concat(F.coalesce(F.col("code_prompt"), F.lit("")),
                    F.coalesce(F.col("canonical_solution"), F.lit("")))
    df = tasks.select("task_id", "code_prompt", "canonical_solution", code.alias("code"),
                      *([F.col(order_col).alias("_ord")] if order_col else []))
    if order_col is None:
        return df
    return (df.groupBy("task_id")
              .agg(F.max_by(F.struct("code_prompt", "canonical_solution", "code"), "_ord").alias("_r"))
              .select("task_id", "_r.code_prompt", "_r.canonical_solution", "_r.code"))


def apply_patches(corpus: DataFrame, patches: DataFrame, *, code_col: str = "code") -> DataFrame:
    """B1: prepend a fixed line (e.g. a missing import) to the code of named tasks.

    ``patches(task_id, prefix)`` is a short literal list; the join is
    broadcast explicitly because its size is fixed by the caller.
    """
    p = F.broadcast(patches.select(F.col("task_id").alias("_pt"), F.col("prefix").alias("_prefix")))
    j = corpus.join(p, corpus["task_id"] == p["_pt"], "left")
    return j.withColumn(code_col, F.concat(F.coalesce(F.col("_prefix"), F.lit("")), F.col(code_col))) \
            .drop("_pt", "_prefix")


def patch_table(spark, patches: dict) -> DataFrame:
    return spark.createDataFrame(sorted(patches.items()), "task_id string, prefix string")


def file_name(task_id_col: str = "task_id"):
    """A6 helper: the part of the task id after the last ``/``."""
    return F.substring_index(F.col(task_id_col), "/", -1)
