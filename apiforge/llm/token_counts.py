"""Operator 7: token counts by a map-side two-tier lookup.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens, tier 2 a
cache in every Python worker that encodes what tier 1 lacks.  Pre-tokens are
never shuffled; the text is read once, in place.

Tier 1 only saves work: it is gathered from a bounded sample (``sample_docs``
rows by hash, ``table_size`` entries, so its broadcast is bounded by those two
parameters); every count is exact whatever it holds.

Defined cases: a null text counts like an empty one (0 bytes, 0 tokens); rows
that repeat are counted each; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import tokens

TOKENIZER = "byte_bpe_50k.json"
SAMPLE_DOCS, SAMPLE_TASKS, TABLE_SIZE = 2_000, 8, 32_768


def frequent_pieces(docs: DataFrame, text: str = "text", *, sample_docs: int = SAMPLE_DOCS,
                    table_size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of a bounded sample of rows.

    The sample's tasks hand at most ``table_size`` counts each to the driver
    (``SAMPLE_TASKS`` tasks), so nothing is shuffled by pre-token.
    """
    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(x for x in tokens.pieces(t)[1][:-1]
                            if len(x) <= tokens.CACHED_CHARS and "\0" not in x)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_pydict({"piece": [k for k, _ in top], "n": [n for _, n in top]},
                                         schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    rows = (docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull())
                .filter(F.pmod(F.xxhash64("t"), F.lit(16)) == 0).limit(sample_docs)
                .repartition(SAMPLE_TASKS)
                .mapInArrow(count, "piece string, n long").collect())
    total: Counter = Counter()
    for r in rows:
        total[r["piece"]] += r["n"]
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                 tokenizer: str = TOKENIZER, limit: int = 512,
                 sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``)."""
    spark = docs.sparkSession
    ship_package(spark)
    coder = tokens.Coder(tokenizer, len)
    frequent = frequent_pieces(docs, text, sample_docs=sample_docs, table_size=table_size)
    lengths = bytes(min(255, coder.of(" " + p)) for p in frequent)
    table, key = spark.sparkContext.broadcast(("\0".join(frequent), lengths)), uuid.uuid4().hex

    def tier_one() -> dict:
        names, sizes = table.value
        known = dict(zip(names.split("\0"), sizes)) if sizes else {}
        return {k: n for k, n in known.items() if n < 255}

    def count(batches):
        c = tokens.coder(tokenizer, "lengths", len, key, tier_one)
        for b in batches:
            n = list(tokens.totals(c, b.column(1), sum))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
                .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
                .withColumnRenamed("doc_id", id_col))
