"""Running a completion function and collecting samples.

The model call itself is not part of the library: ``complete`` runs any
user-supplied batch function inside ``mapInPandas`` (Arrow batches, one
Python worker per task).  Everything around it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as P
from ..session import ship_package, stage


def complete(requests: DataFrame, complete_fn: Callable[[pd.DataFrame], list], *,
             keep: tuple = ("id_num", "task_id", "k"), out_col: str = "completion",
             batch_size: int | None = None, partitions: int | None = None) -> DataFrame:
    """``complete_fn(batch) -> list[str]`` (one text per request row) over
    request batches.

    ``keep`` columns pass through and make each output row's key, so a task
    re-run after an executor loss produces the same keys (write with an
    overwrite of the key range or dedupe on the key).  An empty answer list
    for a non-empty batch fails the job, as the original asserted.
    ``batch_size`` bounds the rows handed to one call; ``partitions`` spreads
    a small request table over more tasks (each task runs its own model
    client).
    """
    ship_package(requests.sparkSession)
    keep = [c for c in keep if c in requests.columns]
    fields = [requests.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())]
    schema = T.StructType(fields)
    src = requests.repartition(partitions) if partitions else requests

    def run(batches):
        for pdf in batches:
            step = batch_size or max(len(pdf), 1)
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                texts = list(complete_fn(part))
                if len(part) and not texts:
                    raise RuntimeError("No outputs from model!")
                if len(texts) != len(part):
                    raise RuntimeError(f"completion function returned {len(texts)} texts for {len(part)} rows")
                out = part[keep].copy()
                out[out_col] = texts
                yield out
    return src.mapInPandas(run, schema)


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def complete_rounds(requests: DataFrame, complete_fn: Callable[[pd.DataFrame], list], n_samples: int, *,
                    existing: DataFrame | None = None, keys: tuple = ("id_num", "task_id"), out_col: str = "completion",
                    batch_size: int | None = None, path: str | None = None) -> DataFrame:
    """F9 + F10: rounds of requests until every row of ``requests`` has ``n_samples`` samples or more.

    A round asks for what is missing of each open row (at most ``batch_size``, column ``n_asked``; ``n_existing``
    tells what there is): ``complete_fn(batch) -> list of lists of texts``, one list per row.  A list may be shorter or
    longer than asked for, and all of it is kept; an empty one fails the job, as it would never end.  What is
    still missing goes into the next round, so there are at most ``n_samples`` of them.

    ``existing`` (samples by ``keys``) counts towards the total.  Returns ``keys, k, round`` and the text, ``k`` going
    on from the samples there were.  A round is one written table: with ``path`` (a folder of its own for these requests)
    the rounds lie in ``path/round=<n>``, a run again reads the finished ones and does an unfinished one anew;
    without, they are staged in the session's shared folder.
    """
    spark = requests.sparkSession
    ship_package(spark)
    keys = list(keys)
    have = requests.select(*keys).distinct().withColumn("_have", F.lit(0).cast("long"))
    if existing is not None:
        n = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        have = have.join(n, keys, "left").select(*keys, F.coalesce("_n", F.lit(0)).cast("long").alias("_have"))
    have = stage(have, "have")
    asked = F.lit(n_samples) - F.col("n_existing")
    if batch_size:
        asked = F.least(asked, F.lit(batch_size))
    schema = T.StructType([*(requests.schema[k] for k in keys), T.StructField("k", T.LongType()), T.StructField(out_col, T.StringType())])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            answers = list(complete_fn(pdf))
            if len(answers) != len(pdf):
                raise RuntimeError(f"completion function returned {len(answers)} lists for {len(pdf)} rows")
            if not all(len(a) for a in answers):
                raise RuntimeError("No outputs from model!")
            out = pdf[keys].loc[pdf.index.repeat([len(a) for a in answers])].reset_index(drop=True)
            out["k"] = [first + i for first, a in zip(pdf["n_existing"], answers) for i in range(len(a))]
            out[out_col] = [t for a in answers for t in a]
            yield out

    rounds = []
    while True:
        open_ = have.filter(F.col("_have") < n_samples)
        if open_.isEmpty():
            break
        number = len(rounds) + 1
        at = f"{path.rstrip('/')}/round={number}" if path else None
        if not (at and _exists(spark, f"{at}/_SUCCESS")):
            rows = requests.join(open_.withColumnRenamed("_have", "n_existing"), keys).withColumn("n_asked", asked)
            made = rows.mapInPandas(run, schema)
            if at:
                made.write.mode("overwrite").parquet(at)
            else:
                made = stage(made, f"round-{number}")
        if at:
            made = spark.read.schema(schema).parquet(at)
        rounds.append(made.withColumn("round", F.lit(number)))
        got = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        have = stage(open_.join(got, keys, "left").select(*keys, (F.col("_have") + F.coalesce("_n", F.lit(0))).alias("_have")), "have")
    if not rounds:
        return spark.createDataFrame([], schema).withColumn("round", F.lit(0))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def normalize_completion(c: Column) -> Column:
    """tabs become four spaces."""
    return F.replace(c, F.lit("\t"), F.lit("    "))


def cut_at_stop(c: Column, stops: list | None = None) -> Column:
    """the text ends before the first occurrence of any stop string
    (three end tokens and the closing code fence by default)."""
    stops = P.STOP_STRINGS if stops is None else stops
    positions = [F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops]
    first = F.least(*positions) if len(positions) > 1 else positions[0]
    return F.when(first.isNotNull(), F.substr(c, F.lit(1), first - 1)).otherwise(c)


def fan_out_json_fields(df: DataFrame, col: str = "completion", *, out_col: str = "output") -> DataFrame:
    """a JSON answer gives ``name``, ``signature``, ``short_description``
    (each only when present and not null) and then always the raw text, each
    as its own output row with ``ordinal``; an answer that is not a JSON
    object gives only the raw text."""
    fields = [F.get_json_object(F.col(col), f"$.{k}") for k in ("name", "signature", "short_description")]
    # the type of the parsed value decides, whatever white space stands before it
    is_obj = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(F.col(col))), F.lit("OBJECT")), F.lit(False))
    items = F.array(*[F.when(is_obj, f) for f in fields], F.col(col))
    return df.select("*", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("ordinal", out_col))


def to_samples(df: DataFrame, *, api_name: str = "api_name", text: str = "completion") -> DataFrame:
    """``(id_num, task_id, api_name, synthesis)``."""
    return df.select("id_num", "task_id", F.col(api_name).alias("api_name"), F.col(text).alias("synthesis"))
