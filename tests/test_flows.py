"""End-to-end: corpus -> calls -> schema rows -> requests -> samples -> curation,
and the streaming collector."""

import os
import tempfile

from pyspark.sql import functions as F

from apiforge.plans.q_requests import echo_completion
from apiforge.operators import complete as CMP
from apiforge.plans import flows
from apiforge.streaming import incremental

CODE = ("import pandas as pd\nimport numpy as np\nfrom math import pi\n"
        "df = pd.DataFrame(d)\nx = np.linalg.inv(a)\ny = df.head(3)\nz = pi\n")


def catalog(spark):
    return spark.createDataFrame([
        ("pandas", "module", None, None), ("pandas.DataFrame", "class", "(data=None, index=None)", None),
        ("pandas.DataFrame.head", "callable", "(self, n: int = 5)", None),
        ("numpy", "module", None, None), ("numpy.linalg", "module", None, None),
        ("numpy.linalg.inv", "callable", "(a)", None), ("math", "module", None, None),
        ("math.pi", "constant", None, "3.141592653589793")],
        "symbol string, kind string, signature string, value string")


def test_three_stages(spark):
    tasks = spark.createDataFrame([("B/1", CODE, "")], "task_id string, code_prompt string, canonical_solution string")
    out = flows.extract_stage(tasks)
    calls = {r["api_call"] for r in out["api"].collect()}
    assert "pandas.DataFrame(d)" in calls and "numpy.linalg.inv(a)" in calls
    assert "pandas.DataFrame(d).head(3)" in calls
    schemas = flows.describe_stage(out["call_lists"], catalog(spark))
    rows = {r["full_name"]: r for r in schemas.collect()}
    assert "numpy.linalg.inv" in rows
    assert rows["numpy.linalg.inv"]["parameters_json"] == '{"type": "object", "properties": {"a": {}}}'
    ids = sorted(r["id_num"] for r in rows.values())
    assert ids == list(range(len(ids)))
    reqs = flows.request_stage(schemas, out["corpus"], n_samples=3)
    assert reqs.count() == 3 * len(ids)
    assert all("# Given API schema" in r["prompt"] for r in reqs.collect())
    samples = flows.collect_stage(reqs, echo_completion)
    assert samples.count() == 3 * len(ids)
    again = flows.request_stage(schemas, out["corpus"], existing=samples, n_samples=3)
    assert again.count() == 0
    curated, missing = flows.curate_stage(samples, schemas)
    assert missing.count() == 0
    kept = {r["api_id"] for r in curated.collect()}
    types = {r["id_num"]: r["type"] for r in schemas.collect()}
    assert kept == {i for i, t in types.items() if t == "function" or t is None}


def test_stream_completions(spark):
    base = tempfile.mkdtemp(prefix="apiforge-stream-")
    src = os.path.join(base, "requests")
    reqs = spark.range(6).select(F.col("id").alias("id_num"), F.lit("t").alias("task_id"),
                                 (F.col("id") % 2).alias("k"), F.lit("api").alias("api_name"))
    reqs.write.parquet(src)
    q = incremental.stream_completions(spark, src, reqs.schema, os.path.join(base, "out"),
                                       os.path.join(base, "ckpt"), echo_completion)
    q.awaitTermination(120)
    got = incremental.read_samples(spark, os.path.join(base, "out"))
    assert got.count() == 6
    # a second run finds nothing new (the stream checkpoint remembers the files)
    q2 = incremental.stream_completions(spark, src, reqs.schema, os.path.join(base, "out"),
                                        os.path.join(base, "ckpt"), echo_completion)
    q2.awaitTermination(120)
    assert incremental.read_samples(spark, os.path.join(base, "out")).count() == 6
