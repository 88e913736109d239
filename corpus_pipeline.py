"""The corpus pipeline: five stages over ``documents``, each written as Parquet and
reread as the next one's input.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame: the columns of
``documents`` but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiforge.llm import lines, mixing, neardup, packing, quality
from apiforge.session import read_table, shuffled, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more).

    It learns from all labels of the input's documents; texts that are null are
    scored as empty ones, rows without id like any others, repeated rows alike.  Columns of any name pass.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return quality.score(whole, model, text="_text").filter(F.col("score") >= 0.5).select("_doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs of 50 words or more.

    A document of which nothing is left goes; ``n_chars`` follows the new text.  Null and empty texts
    stay as they are, repeated rows (same id and text) count once and get one result each; rows without id come
    first in the order of copies.  Columns of any name pass.
    """
    rows = lines.dedup_lines(docs).filter((F.col("n_deleted") < F.col("n_lines")) | (F.col("n_deleted") == 0))
    changed = F.col("n_deleted") > 0
    new = {"text": F.col("_text"), "n_chars": F.when(changed, F.length("_text").cast("long")).otherwise(F.col("_doc.n_chars"))}
    return rows.withColumnRenamed("text", "_text").select(
        *(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: the smallest id, any id
    before none.

    Rows are numbered first and judged one by one, so an id with several texts loses only the copies
    among them, and repeated rows and copies without id leave one row too.  Texts without words are linked with
    nothing and stay.  Columns of any name pass.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "rows")
    found = neardup.near_duplicates(rows.select("_row", F.col("_doc.text").alias("text")), id_col="_row", width=5, num=80, den=100)
    found = stage(found.select("_row", "component_id"), "components")
    ids = shuffled(found).join(rows.select("_row", F.col("_doc.doc_id").alias("_id")), "_row")
    first = ids.groupBy("component_id").agg(
        F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row"))["_row"].alias("_first"),
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    gone = stage(ids.join(shuffled(first), "component_id").filter(F.col("_row") != F.col("_first")).select("_row"), "gone")
    small = gone.count() <= neardup.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else shuffled(gone), "_row", "left_anti").select("_doc.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0, 1 or 2 times).

    A null text has no words and follows its source; documents of a null source are one source; repeated rows
    share their draw.  Columns of any name pass.
    """
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence of 2048 tokens and place in it.

    A null or empty text is its end id; repeated rows and rows without id are packed each.  Other columns go.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: The classifier's network and the tokenizer are not expressible in SQL; tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage-{k}")
    return docs
