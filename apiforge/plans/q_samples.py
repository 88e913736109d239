"""Checked queries for requests, plans and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate, numbering, requests
from .registry import query, table

N_SAMPLES = 10
BATCH = 4


def samples_from_events(spark, sf):
    """events as collected samples: api_id = user, synthesis = JSON with the event type."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("api_id"),
                    F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('"}')).alias("synthesis"))


def apis_from_customers(spark, sf):
    """customers as the api table: kind from the market segment, error for a negative balance."""
    c = table(spark, sf, "customer")
    kind = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "click")
             .when(F.col("c_mktsegment") == "BUILDING", "view")
             .when(F.col("c_mktsegment") == "FURNITURE", "purchase")
             .when(F.col("c_mktsegment") == "HOUSEHOLD", "signup")
             .otherwise("error"))
    err = F.when(F.col("c_acctbal") < 0, F.lit("negative balance"))
    return c.select(F.col("c_custkey").alias("api_id"), kind.alias("type"), err.alias("error"))


_SAMPLES_SQL = """
samples AS (SELECT event_id, user_id AS api_id, '{"type": "' || event_type || '"}' AS synthesis FROM events),
apis AS (SELECT c_custkey AS api_id,
                CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'click' WHEN 'BUILDING' THEN 'view'
                     WHEN 'FURNITURE' THEN 'purchase' WHEN 'HOUSEHOLD' THEN 'signup' ELSE 'error' END AS type,
                CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS error
         FROM customer)"""


@query("dedupe_exact", """
SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text
""")
def q_dedupe_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return curate.dedupe_exact(d, order_col="doc_id")


@query("curate_negative", """
SELECT DISTINCT api_id, synthesis FROM (SELECT user_id AS api_id, '{"type": "' || event_type || '"}' AS synthesis FROM events)
""")
def q_curate_negative(spark, sf):
    return curate.curate_negative(samples_from_events(spark, sf).drop("event_id"))


@query("curate_positive", f"""
WITH {_SAMPLES_SQL},
dedup AS (SELECT min(event_id) AS event_id, api_id, synthesis FROM samples GROUP BY api_id, synthesis)
SELECT d.event_id, d.api_id, d.synthesis FROM dedup d JOIN apis a ON d.api_id = a.api_id
WHERE a.error IS NOT NULL OR a.type = json_extract_string(d.synthesis, '$.type')
""")
def q_curate_positive(spark, sf):
    return curate.curate_positive(samples_from_events(spark, sf), apis_from_customers(spark, sf),
                                  order_col="event_id")


@query("validate_type", f"""
WITH {_SAMPLES_SQL}
SELECT s.event_id, s.api_id, s.synthesis FROM samples s JOIN apis a ON s.api_id = a.api_id
WHERE a.error IS NOT NULL OR a.type = json_extract_string(s.synthesis, '$.type')
""")
def q_validate_type(spark, sf):
    return curate.validate_type(samples_from_events(spark, sf), apis_from_customers(spark, sf))


@query("check_coverage", f"""
WITH {_SAMPLES_SQL}
SELECT a.api_id, a.type, a.error FROM apis a WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.api_id = a.api_id)
""")
def q_check_coverage(spark, sf):
    return curate.check_coverage(samples_from_events(spark, sf), apis_from_customers(spark, sf))


@query("validate_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '{bad ' || props ELSE props END AS synthesis,
       json_valid(CASE WHEN event_type = 'error' THEN '{bad ' || props ELSE props END) AS json_ok
FROM events
""")
def q_validate_json(spark, sf):
    e = table(spark, sf, "events")
    s = e.select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("{bad "), F.col("props")))
                 .otherwise(F.col("props")).alias("synthesis"))
    return curate.validate_json(s, "synthesis", strict=False)


# ---- resumable plans over events: (user, event type) pairs are the schema rows,
# ---- events with value < 20 are the samples already on disk

_PLAN_SQL = """
schemas AS (SELECT DISTINCT user_id AS id_num, event_type AS task_id FROM events),
existing AS (SELECT user_id AS id_num, event_type AS task_id, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL),
counts AS (SELECT s.id_num, s.task_id, coalesce(e.n, 0) AS n_existing,
                  greatest(10 - coalesce(e.n, 0), 0) AS n_missing
           FROM schemas s LEFT JOIN existing e USING (id_num, task_id))"""


def _plan_inputs(spark, sf):
    e = table(spark, sf, "events")
    schemas = e.select(F.col("user_id").alias("id_num"), F.col("event_type").alias("task_id")).distinct()
    existing = (e.where(F.col("value") < 20)
                 .select(F.col("user_id").alias("id_num"), F.col("event_type").alias("task_id")))
    return schemas, existing


@query("existing_counts", """
SELECT user_id AS id_num, event_type AS task_id, count(*) AS n_existing FROM events WHERE value < 20 GROUP BY ALL
""")
def q_existing_counts(spark, sf):
    _, existing = _plan_inputs(spark, sf)
    return requests.existing_counts(existing)


@query("plan_remaining", f"""
WITH {_PLAN_SQL}
SELECT id_num, task_id, n_existing, k FROM counts, unnest(range(n_existing, 10)) AS t(k)
""")
def q_plan_remaining(spark, sf):
    schemas, existing = _plan_inputs(spark, sf)
    return requests.plan_remaining(schemas, existing, N_SAMPLES)


@query("plan_remaining_fresh", """
SELECT DISTINCT user_id AS id_num, event_type AS task_id, 0::BIGINT AS n_existing, k
FROM events, unnest(range(0, 10)) AS t(k)
""")
def q_plan_remaining_fresh(spark, sf):
    schemas, existing = _plan_inputs(spark, sf)
    return requests.plan_remaining(schemas, existing, N_SAMPLES, resume=False)


@query("plan_batches", f"""
WITH {_PLAN_SQL}
SELECT id_num, task_id, n_existing, b AS batch_no, n_existing + b * 4 AS first_k,
       least(4, n_missing - b * 4) AS n_in_batch
FROM counts, unnest(range(0, CAST(ceil(n_missing / 4) AS BIGINT))) AS t(b)
WHERE n_missing > 0
""")
def q_plan_batches(spark, sf):
    schemas, existing = _plan_inputs(spark, sf)
    return requests.plan_batches(requests.plan_counts(schemas, existing, N_SAMPLES), BATCH)


@query("assign_id_num", """
SELECT id_num, l_orderkey, l_linenumber FROM (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id_num, l_orderkey, l_linenumber
  FROM lineitem)
WHERE id_num >= 1000 AND id_num < 5000
""")
def q_assign_id_num(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    numbered = numbering.assign_id_num(li, ["l_orderkey", "l_linenumber"])
    return requests.filter_id_range(numbered, 1000, 5000).select("id_num", "l_orderkey", "l_linenumber")


@query("skip_classes", """
SELECT p_partkey, p_name FROM part
WHERE (CASE p_type WHEN 'SMALL' THEN 'class' WHEN 'ECONOMY' THEN NULL ELSE 'method' END) IS DISTINCT FROM 'class'
""")
def q_skip_classes(spark, sf):
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "SMALL", "class").when(F.col("p_type") == "ECONOMY", F.lit(None)) \
            .otherwise("method")
    return requests.skip_classes(p.select("p_partkey", "p_name", kind.alias("type")))
