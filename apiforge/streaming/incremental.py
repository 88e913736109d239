"""Incremental collection of samples with Structured Streaming.

The original appended samples to one file and, on restart, re-read that
file to skip what was done.  Here request rows arrive as files in a folder
(e.g. the output of ``plan_remaining`` written per run); a streaming query
completes each micro-batch and writes it to its own folder keyed by the
batch id.  A micro-batch replayed after a failure overwrites exactly its own
output, so the sink is idempotent, and the stream's checkpoint records
which input files were done (resume without re-reading the output).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import complete as CMP
from ..session import ship_package


def stream_completions(spark: SparkSession, requests_path: str, schema: T.StructType | str,
                       sink_path: str, checkpoint_location: str,
                       complete_fn: Callable[[pd.DataFrame], list], *,
                       api_name_col: str = "api_name", batch_size: int | None = None,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``requests_path`` holds parquet request rows with ``id_num, task_id, k``,
    ``api_name_col`` and whatever ``complete_fn`` reads.  With
    ``available_now`` the query processes what is there and stops.
    """
    ship_package(spark)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(requests_path)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        keep = ("id_num", "task_id", "k", api_name_col)
        done = CMP.complete(df, complete_fn, keep=keep, batch_size=batch_size)
        text = CMP.normalize_completion(CMP.cut_at_stop(done["completion"]))
        samples = done.select("id_num", "task_id", "k", done[api_name_col].alias("api_name"),
                              text.alias("synthesis"))
        samples.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch={batch_id}")

    w = src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_samples(spark: SparkSession, sink_path: str) -> DataFrame:
    """All samples written so far (one folder per micro-batch)."""
    return spark.read.parquet(sink_path).drop("batch")
