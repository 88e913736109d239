"""Curation of collected samples.

All operators are lazy DataFrame transforms.  Aborting checks of the
original batch job ("unknown api id", "bad JSON", "api not covered") are
expressed with ``raise_error`` inside the plan, so they fail the job on the
executors that see the offending row instead of collecting rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_exact(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """G1: drop rows equal on every field; the first row (by ``order_col``) stays.

    Hash aggregation with map-side partial aggregation, so a value repeated in
    a third of all rows collapses to one row per map task before the shuffle.
    Without ``order_col`` this is ``dropDuplicates()``.
    """
    if order_col is None:
        return df.dropDuplicates()
    keys = [c for c in df.columns if c != order_col]
    return (df.groupBy(*keys).agg(F.min(order_col).alias(order_col))
              .select(*df.columns))


def _synthesis_type(synthesis: Column, strict: bool) -> Column:
    if strict:
        # parse_json raises on malformed JSON: the reference aborts as well.
        return F.variant_get(F.parse_json(synthesis), "$.type", "string")
    return F.try_variant_get(F.try_parse_json(synthesis), "$.type", "string")


def validate_type(samples: DataFrame, apis: DataFrame, *, key: str = "api_id",
                  type_map: dict | None = None, strict: bool = True) -> DataFrame:
    """Keep a sample if its api is in error or the api type equals the
    ``type`` field of the JSON ``synthesis``.

    ``apis(api_id, type, error)`` is joined without a broadcast hint: AQE
    turns the join into a broadcast join only when the measured size of the
    apis side is under the broadcast threshold, else it stays sort-merge.
    ``type_map`` (V9) optionally maps resolver kinds (e.g. ``callable``) to the
    kinds offered in the prompt before comparing.
    """
    # one row per api id: an id listed twice must not multiply samples
    a = (apis.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("type", "error")).alias("_a"))
             .select("_k", F.col("_a.type").alias("_api_type"), F.col("_a.error").alias("_api_error"),
                     F.lit(True).alias("_known")))
    j = samples.join(a, samples[key] == a["_k"], "left")
    api_type = F.col("_api_type")
    if type_map:
        m = F.create_map(*[F.lit(x) for kv in type_map.items() for x in kv])
        api_type = F.coalesce(m[api_type], api_type)
    syn_type = _synthesis_type(F.col("synthesis"), strict)
    keep = F.col("_api_error").isNotNull() | (api_type == syn_type)
    keep = F.coalesce(keep, F.lit(False))
    if strict:
        keep = (F.when(F.col("_known").isNull(),
                       F.raise_error(F.concat(F.lit("unknown api id: "),
                                              F.coalesce(F.col(key).cast("string"), F.lit("null")))))
                 .when(F.col("_api_error").isNull() & syn_type.isNull(),
                       F.raise_error(F.concat(F.lit("synthesis without a type, api id "), F.col(key).cast("string"))))
                 .otherwise(keep))
    return j.where(keep).select(*samples.columns)


def check_coverage(samples: DataFrame, apis: DataFrame, *, key: str = "api_id") -> DataFrame:
    """The apis that have no sample at all (left anti join)."""
    return apis.join(samples.select(key).distinct(), key, "left_anti")


def assert_coverage(samples: DataFrame, apis: DataFrame, *, key: str = "api_id") -> None:
    """G3 as a check: raise with all missing ids if any api is uncovered.

    The ids are named by the error only, so they come to the driver only when
    the check has failed; ``check_coverage`` gives the same as a table.
    """
    missing = check_coverage(samples, apis, key=key).select(key).distinct()
    if not missing.isEmpty():
        raise AssertionError(f"Missing {sorted(r[0] for r in missing.collect())}")


def validate_json(df: DataFrame, col: str, *, strict: bool = True) -> DataFrame:
    """Every value of ``col`` must be JSON; values pass through unchanged.

    strict: fail the job on the first bad value.  Otherwise add ``json_ok``
    so bad rows can be routed to a quarantine table.
    """
    if strict:
        return df.withColumn(col, F.when(F.parse_json(F.col(col)).isNotNull() | F.col(col).isNull(),
                                         F.col(col)))
    return df.withColumn("json_ok", F.try_parse_json(F.col(col)).isNotNull())


def curate_positive(samples: DataFrame, apis: DataFrame, *, order_col: str | None = None,
                    key: str = "api_id", type_map: dict | None = None,
                    strict: bool = True, coverage: bool = False) -> DataFrame:
    """Dedup, coverage (``coverage=True`` fails the run on an api without samples,
    before anything is kept), then type check."""
    d = dedupe_exact(samples, order_col)
    if coverage:
        assert_coverage(d, apis, key=key)
    return validate_type(d, apis, key=key, type_map=type_map, strict=strict)


def curate_negative(samples: DataFrame, *, order_col: str | None = None) -> DataFrame:
    """Dedup only."""
    return dedupe_exact(samples, order_col)
