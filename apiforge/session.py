"""Spark session helpers.

The library never creates its own session inside an operator; these helpers
exist for tests, the bench and the driver entry point.  Operators that need to
cut lineage read ``spark.checkpoint.dir`` from the session (see
``checkpoint_dir``) and only fall back to a local scratch folder when the
session runs in local mode and nothing was configured.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a sort-merge join into a broadcast join only when the
    # measured size of a finished shuffle stage is below this bound, so the
    # broadcast side is always size-checked at run time.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "apiforge",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    A job that was submitted with a master keeps that master, its memory and
    its partition counts; the local settings below apply only where the caller
    asks for them or where no master is configured (tests, bench, laptop).
    """
    given = SparkConf()
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    local = master or (None if given.contains("spark.master")
                       else f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    if local:
        builder = builder.master(local)
        cores = re.match(r"local\[(\d+)\]", local)
        if shuffle_partitions is None and cores:
            shuffle_partitions = int(cores.group(1))
        if not given.contains("spark.driver.memory"):
            conf["spark.driver.memory"] = os.environ.get("APIFORGE_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local-mode
    session without that setting (tests, laptop runs) gets a fresh scratch
    folder; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/DBFS) "
                           "before running iterative operators on a cluster")
    path = tempfile.mkdtemp(prefix="apiforge-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


_STAGED: dict = {}


def stage(df: DataFrame, label: str = "rows", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, computes the plan once, and the
    copy keeps column pruning, filter pushdown and statistics.  Whatever
    was computed per task (partition ids, positions) is data afterwards.  The
    folders stay until ``release_stages``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/apiforge-stages/{uuid.uuid4().hex}-{label}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of a join that Spark must not broadcast.

    Spark plans a broadcast by an estimate that is far too low for ids (a file holds a few bytes of a row that takes
    a hundred in memory), arrays (counted as one element) and exploded rows (counted as one a list).  So at some sizes of the
    input it builds tables of hundreds of MB in the driver.
    """
    return side.hint("merge")


def release_stages(spark: SparkSession) -> int:
    """Delete the staged tables of this application (call it when no DataFrame
    built on them is used any more); returns how many folders went."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written copy of ``df`` in the session's shared folder.

    Used between rounds of iterative operators so a lost executor recomputes
    from the last written round instead of from the source.
    """
    return stage(df, "round")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``apiforge`` importable in the Python workers of this session.

    Operators that run Python on executors (``mapInPandas``) pickle their
    functions by module name, so the workers must import this package.  The
    package sources are zipped once per application and handed to
    ``addPyFile`` (what ``--py-files`` does); Spark serves the file to every
    executor.  Harmless when the package is installed on the cluster anyway.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="apiforge-pyfiles-"), "apiforge.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(key)
