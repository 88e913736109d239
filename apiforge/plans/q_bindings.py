"""Checked query for binding resolution at volume (C2, C3) on ``events``.

Each event is one binding ``<event_type> = <root>.f<k>(<event_id>)`` in the
file of its user, in event order; the root is the module alias ``np``
(imported at the top of every file) or, for a third of the events, one of
the event-type variables, so chains of rebinding form.  A small block size
makes the as-of lookup use its block carry path at every scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators.scan import FACT_SCHEMA
from .registry import query, table

BLOCK = 1 << 12
VARS = ["click", "view", "purchase", "signup", "error"]


def binding_facts(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(*[F.lit(v) for v in VARS])
    root = F.when(k % 3 == 0, F.element_at(names, (k % 5 + 1).cast("int"))).otherwise(F.lit("np"))
    rest = F.concat(F.lit(".f"), k.cast("string"), F.lit("("), F.col("event_id").cast("string"), F.lit(")"))
    task = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    binds = e.select(task.alias("task_id"), (F.col("event_id") * 2).alias("seq"),
                     (F.col("event_id") * 2 + 1).alias("seq_end"), F.lit("bind").alias("fact"),
                     F.lit("call").alias("kind"), F.col("event_type").alias("name"),
                     F.concat(root, rest).alias("target"), root.alias("root"), rest.alias("rest"))
    imports = (e.select(task.alias("task_id")).distinct()
                .select("task_id", F.lit(-1).cast("long").alias("seq"), F.lit("import").alias("fact"),
                        F.lit("module").alias("kind"), F.lit("np").alias("name"), F.lit("numpy").alias("target")))
    facts = binds.unionByName(imports, allowMissingColumns=True)
    return facts.select(*[F.col(f.name).cast(f.dataType) if f.name in facts.columns
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA.fields])


@query("resolve_bindings", """
WITH RECURSIVE
b AS (SELECT 'U' || user_id AS task_id, event_id, event_type AS var, CAST(props->>'k' AS BIGINT) AS k FROM events),
b2 AS (SELECT *, CASE WHEN k % 3 = 0 THEN ['click', 'view', 'purchase', 'signup', 'error'][k % 5 + 1] ELSE 'np' END AS root,
              '.f' || k || '(' || event_id || ')' AS rest FROM b),
par AS (SELECT c.*, (SELECT max(p.event_id) FROM b2 p
                     WHERE p.task_id = c.task_id AND p.var = c.root AND p.event_id < c.event_id) AS pid FROM b2 c),
r AS (SELECT task_id, event_id, var, CASE WHEN root = 'np' THEN 'numpy' || rest ELSE root || rest END AS text
      FROM par WHERE root = 'np' OR pid IS NULL
      UNION ALL
      SELECT c.task_id, c.event_id, c.var, r.text || c.rest FROM par c JOIN r
        ON c.task_id = r.task_id AND c.pid = r.event_id AND c.root <> 'np')
SELECT task_id, event_id, var, text FROM r
""")
def q_resolve_bindings(spark, sf):
    b = R.resolve_bindings(binding_facts(spark, sf), block=BLOCK)
    return b.select("task_id", (F.col("id") / 2).cast("long").alias("event_id"), "var", "text")


@query("bindings_variable_map", """
WITH RECURSIVE
b AS (SELECT 'U' || user_id AS task_id, event_id, event_type AS var, CAST(props->>'k' AS BIGINT) AS k FROM events),
b2 AS (SELECT *, CASE WHEN k % 3 = 0 THEN ['click', 'view', 'purchase', 'signup', 'error'][k % 5 + 1] ELSE 'np' END AS root,
              '.f' || k || '(' || event_id || ')' AS rest FROM b),
par AS (SELECT c.*, (SELECT max(p.event_id) FROM b2 p
                     WHERE p.task_id = c.task_id AND p.var = c.root AND p.event_id < c.event_id) AS pid FROM b2 c),
r AS (SELECT task_id, event_id, var, CASE WHEN root = 'np' THEN 'numpy' || rest ELSE root || rest END AS text
      FROM par WHERE root = 'np' OR pid IS NULL
      UNION ALL
      SELECT c.task_id, c.event_id, c.var, r.text || c.rest FROM par c JOIN r
        ON c.task_id = r.task_id AND c.pid = r.event_id AND c.root <> 'np')
SELECT task_id, var, arg_max(text, event_id) AS text FROM r GROUP BY task_id, var
""")
def q_bindings_variable_map(spark, sf):
    return R.variable_map(R.resolve_bindings(binding_facts(spark, sf), block=BLOCK))
