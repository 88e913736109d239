"""Schema building over node rows.

Signatures repeat massively (every call of one API carries the same
signature text), so the parser runs once per *distinct* signature and the
result is joined back.  The distinct step is a hash aggregate with map-side
partial aggregation (a signature held by a third of all rows collapses before
the shuffle); the join back is planned by AQE from the measured size of the
distinct set: a broadcast hash join when it is small, a sort-merge join with
skew splitting otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signature as S


def with_parameter_schema(df: DataFrame, sig_col: str = "signature", *, kind_col: str | None = None,
                          out_col: str = "parameters_json", distinct_first: bool = True) -> DataFrame:
    """Add the JSON parameter schema of ``sig_col``.

    With ``kind_col`` the constant rule applies (E6): ``type = 'constant'``
    gives ``{"type": "constant"}`` whatever the signature.
    """
    if not distinct_first:
        expr = (S.schema_json(F.col(kind_col), F.col(sig_col)) if kind_col
                else F.when(F.col(sig_col) != "", S.parameter_schema(S.parse_signature(F.col(sig_col)))))
        return df.withColumn(out_col, expr)
    sigs = (df.select(F.col(sig_col).alias("_sig")).where(F.col("_sig").isNotNull() & (F.col("_sig") != ""))
              .distinct()
              .select("_sig", S.parameter_schema(S.parse_signature(F.col("_sig"))).alias("_schema")))
    j = df.join(sigs, df[sig_col] == sigs["_sig"], "left")
    out = F.col("_schema")
    if kind_col:
        out = F.when(F.col(kind_col) == "constant", F.lit(S.CONSTANT_SCHEMA)).otherwise(out)
    return j.withColumn(out_col, out).drop("_sig", "_schema")


def with_parameters(df: DataFrame, sig_col: str = "signature", out_col: str = "params") -> DataFrame:
    """Structured form of E1-E4: ``array<struct<pos, name, types, has_default, default>>``."""
    return df.withColumn(out_col, S.parse_signature(F.col(sig_col)))
