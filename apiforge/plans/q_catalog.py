"""Checked queries for catalog resolution and the node tree.

The catalog is rendered from ``part``: a module per part type, a class per
(type, brand), a member per (type, brand, second name word) whose kind is
chosen by the size, and a function per (type, first name word).  A symbol
produced by several rows keeps the row with the smallest part key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import tree
from ..operators.numbering import assign_id_num
from . import flows
from .registry import query, table

_PARTS_SQL = """
SELECT p_partkey, p_size, lower(p_type) AS t, 'B' || split_part(p_brand, '#', 2) AS b,
       split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS w FROM part"""

_CATALOG_SQL = f"""
WITH p AS ({_PARTS_SQL}),
rows AS (
  SELECT p_partkey, t AS symbol, 'module' AS kind, NULL AS signature, NULL AS value FROM p
  UNION ALL SELECT p_partkey, t || '.' || b, 'class', '(self, x, y=1)', NULL FROM p
  UNION ALL SELECT p_partkey, t || '.' || b || '.' || w,
     CASE p_size % 4 WHEN 0 THEN 'callable' WHEN 1 THEN 'constant' WHEN 2 THEN 'class' ELSE 'module' END,
     CASE p_size % 4 WHEN 0 THEN '(a, b=2, *args, **kw)' WHEN 2 THEN '(self, n: int = 0)' END,
     CASE p_size % 4 WHEN 1 THEN CAST(p_size AS VARCHAR) END FROM p
  UNION ALL SELECT p_partkey, t || '.' || adj, 'callable', '(q, r=None)', NULL FROM p)
SELECT symbol, r.kind AS kind, r.signature AS signature, r.value AS value
FROM (SELECT symbol, arg_min({{'kind': kind, 'signature': signature, 'value': value}}, p_partkey) AS r FROM rows GROUP BY symbol)"""

_CALL_SQL = """CASE p_size % 4
  WHEN 0 THEN t || '.' || b || '.' || w || '(' || p_size || ')'
  WHEN 1 THEN t || '.' || b || '.' || w || '.extra(k=' || p_size || ')'
  WHEN 2 THEN t || '.' || adj || '(' || p_size || ', 1)'
  ELSE 'nomod.' || w || '()' END"""


def catalog(spark, sf):
    p = table(spark, sf, "part")
    spark_parts = p.select("p_partkey", "p_size", F.lower("p_type").alias("t"),
                           F.concat(F.lit("B"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("b"),
                           F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"),
                           F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w"))
    m = spark_parts.select("p_partkey", F.col("t").alias("symbol"), F.lit("module").alias("kind"),
                           F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("value"))
    c = spark_parts.select("p_partkey", F.concat_ws(".", "t", "b").alias("symbol"), F.lit("class").alias("kind"),
                           F.lit("(self, x, y=1)").alias("signature"), F.lit(None).cast("string").alias("value"))
    r = F.col("p_size") % 4
    mem = spark_parts.select(
        "p_partkey", F.concat_ws(".", "t", "b", "w").alias("symbol"),
        F.when(r == 0, "callable").when(r == 1, "constant").when(r == 2, "class").otherwise("module").alias("kind"),
        F.when(r == 0, "(a, b=2, *args, **kw)").when(r == 2, "(self, n: int = 0)").alias("signature"),
        F.when(r == 1, F.col("p_size").cast("string")).alias("value"))
    fn = spark_parts.select("p_partkey", F.concat_ws(".", "t", "adj").alias("symbol"),
                            F.lit("callable").alias("kind"), F.lit("(q, r=None)").alias("signature"),
                            F.lit(None).cast("string").alias("value"))
    rows = m.unionByName(c).unionByName(mem).unionByName(fn)
    return (rows.groupBy("symbol").agg(F.min_by(F.struct("kind", "signature", "value"), "p_partkey").alias("_r"))
                .select("symbol", "_r.kind", "_r.signature", "_r.value"))


def task_calls(spark, sf):
    p = table(spark, sf, "part")
    parts = p.select("p_partkey", "p_size", "p_brand", F.lower("p_type").alias("t"),
                     F.concat(F.lit("B"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("b"),
                     F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"),
                     F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w"))
    return parts.select(F.col("p_brand").alias("task_id"), F.col("p_partkey").alias("ord"),
                        F.expr(_CALL_SQL).alias("api_call"))


@query("resolve_calls", f"""
WITH cat AS ({_CATALOG_SQL}),
p0 AS ({_PARTS_SQL}),
calls AS (SELECT DISTINCT {_CALL_SQL} AS api_call FROM p0),
p AS (SELECT api_call, string_split(split_part(api_call, '(', 1), '.') AS path FROM calls),
pre AS (SELECT api_call, path, d, array_to_string(path[1:d], '.') AS symbol FROM p, range(1, len(path) + 1) t(d)),
hits AS (SELECT pre.*, cat.kind, cat.value, cat.signature AS full_sig FROM pre LEFT JOIN cat USING (symbol)),
dep AS (SELECT api_call, coalesce(min(CASE WHEN kind IS NULL THEN d END) - 1, max(d)) AS depth FROM hits GROUP BY api_call),
best AS (SELECT h.api_call, h.path, dep.depth, h.kind, h.value, h.full_sig FROM dep JOIN hits h ON h.api_call = dep.api_call AND h.d = greatest(dep.depth, 1))
SELECT api_call,
       CASE WHEN depth >= 1 THEN array_to_string(path, '.') ELSE api_call END AS name,
       CASE WHEN depth >= 1 THEN kind END AS type,
       CASE WHEN depth >= 1 AND kind = 'constant' THEN value END AS value,
       -- what the call's form uses of each signature of the catalog
       CASE WHEN depth >= 1 AND kind IN ('class', 'callable') THEN CASE full_sig
         WHEN '(a, b=2, *args, **kw)' THEN CASE WHEN api_call LIKE '%.extra(k=%' THEN '(**kw)' ELSE '(a)' END
         WHEN '(self, n: int = 0)' THEN CASE WHEN api_call LIKE '%.extra(k=%' THEN '(self)' ELSE '(self, n: int = 0)' END
         WHEN '(q, r=None)' THEN '(q, r=None)'
         ELSE full_sig END END AS signature,
       depth >= 1 AS resolved
FROM best
""")
def q_resolve_calls(spark, sf):
    r = C.resolve_calls(task_calls(spark, sf), catalog(spark, sf))
    return r.select("api_call", "name", "type", "value", "signature", "resolved")


#: signature, call (``#`` stands for a number of the row) and what the call uses
_USED = [
    ("(a, b=1, c=None)", "f(#, c=2)", "(a, c=None)"),
    ("(self, x, y=0)", "o.m(#)", "(self, x)"),
    ("(a, **kw)", "f(1, z=#)", "(a, **kw)"),
    ("(a, *args, k=3)", "f(1, 2, #)", "(a, *args, k=3)"),
    ("()", "time.time()", "()"),
    ("()", "f(#)", "()"),
    ("(a, shape=())", "f(#, shape=2)", "(a, shape=())"),
    ("(a, shape=(0, 1))", "f(1, shape=#)", "(a, shape=(0, 1))"),
    ("(self)", "o.m()", "(self)"),
    ("(self, x)", "o.m(1, 2, #)", "(self, x)"),
    ("(a, b) -> tuple[int, str]", "f(#)", "(a)"),
    ("(a, b)", "m.CONST#", "(a, b)"),
    ("(a, m={'x': 1, 'y': (2, 3)}, s=',')", "f(1, m=#, s=2)", "(a, m={'x': 1, 'y': (2, 3)}, s=',')"),
    ("(x: int, *, y: str='a,b')", "f(y=#)", "(y: str='a,b')"),
]


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _used_sql(i: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {_lit(row[i])}" for k, row in enumerate(_USED))
    return f"CASE (l_orderkey + l_linenumber) % {len(_USED)} {cases} END"


@query("used_args", f"""
SELECT l_orderkey, l_linenumber, {_used_sql(0)} AS signature,
       replace({_used_sql(1)}, '#', CAST(l_partkey AS VARCHAR)) AS api_call, {_used_sql(2)} AS used
FROM lineitem
""")
def q_used_args(spark, sf):
    shape = F.element_at(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c, _ in _USED]),
                         ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_USED) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shape.alias("x")).select(
        "l_orderkey", "l_linenumber", F.col("x.s").alias("signature"),
        F.replace(F.col("x.c"), F.lit("#"), F.col("l_partkey").cast("string")).alias("api_call"))
    # a call form is worked out once per distinct text and signature, a signature once, then both are joined back
    forms = rows.select("signature", "api_call").distinct()
    args = rows.select("signature").distinct().withColumn("args", C.signature_args(F.col("signature")))
    used = forms.join(C.call_path(forms), "api_call").join(args, "signature").select(
        "signature", "api_call", C.used_args(F.col("signature"), F.col("n_pos"), F.col("kws"), args=F.col("args")).alias("used"))
    return rows.join(used, ["signature", "api_call"])


_JSON = {"(a)": '{"type": "object", "properties": {"a": {}}}',
         "(self, n: int = 0)": '{"type": "object", "properties": {"n": {"type": "integer", "default": 0}}}',
         "(**kw)": '{"type": "object", "properties": {}}', "(self)": '{"type": "object", "properties": {}}',
         "(q, r=None)": '{"type": "object", "properties": {"q": {}, "r": {"type": "NoneType", "default": null}}}',
         "(self, x, y=1)": '{"type": "object", "properties": {"x": {}, "y": {"type": "integer", "default": 1}}}',
         "(a, b=2, *args, **kw)": '{"type": "object", "properties": {"a": {}, "b": {"type": "integer", "default": 2}}}'}
_JSON_SQL = ("CASE WHEN type = 'constant' THEN '{\"type\": \"constant\"}' ELSE CASE signature "
             + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in _JSON.items()) + " END END")

#: The node maps of this catalog and these calls, case by case: owners of methods, their methods, plain
#: functions, unresolved calls; an owner ``t.b.w`` moves below ``t.b`` where the task has that owner.
_TREE_SQL = f"""
WITH cat AS ({_CATALOG_SQL}),
c AS (SELECT p_brand AS task_id, p_partkey AS ord, part.p_size % 4 AS r, x.t || '.' || x.b AS tb, x.t || '.' || x.b || '.' || x.w AS tbw,
             x.t || '.' || x.adj AS fn, 'nomod.' || x.w || '()' AS lost
      FROM part JOIN ({_PARTS_SQL}) x USING (p_partkey)),
o1 AS (SELECT task_id, tb, min(ord) AS ord FROM c WHERE r = 0 GROUP BY ALL),
o2 AS (SELECT c.task_id, c.tb, c.tbw, min(c.ord) AS ord, any_value(o1.ord) AS below
       FROM c JOIN cat k ON k.symbol = c.tbw LEFT JOIN o1 ON o1.task_id = c.task_id AND o1.tb = c.tb
       WHERE c.r = 1 AND k.kind <> 'module' GROUP BY 1, 2, 3),
m1 AS (SELECT task_id, tb, tbw, min(ord) AS cord FROM c WHERE r = 0 GROUP BY ALL),
n AS (
  -- owners t.b: path of one
  SELECT o1.task_id, tb AS full_name, tb AS name, k.kind AS type, k.signature, NULL AS value, false AS bare,
         [(0, 0, o1.ord)] AS dfs FROM o1 JOIN cat k ON k.symbol = tb
  UNION ALL  -- owners t.b.w, on top or below t.b (where it takes the place of a method of that name)
  SELECT o2.task_id, o2.tbw, o2.tbw, k.kind, CASE WHEN k.kind <> 'constant' THEN k.signature END, CASE WHEN k.kind = 'constant' THEN k.value END,
         o2.below IS NOT NULL,
         CASE WHEN o2.below IS NULL THEN [(0, 0, o2.ord)]
              ELSE [(0, 0, o2.below), CASE WHEN m1.cord IS NULL THEN (1, 0, o2.ord) ELSE (0, 0, m1.cord) END] END
  FROM o2 JOIN cat k ON k.symbol = o2.tbw LEFT JOIN m1 ON m1.task_id = o2.task_id AND m1.tbw = o2.tbw
  UNION ALL  -- their method .extra(k=..), found up to t.b.w
  SELECT o2.task_id, o2.tbw || '.extra', o2.tbw || '.extra', k.kind,
         CASE k.signature WHEN '(a, b=2, *args, **kw)' THEN '(**kw)' WHEN '(self, n: int = 0)' THEN '(self)' END,
         CASE WHEN k.kind = 'constant' THEN k.value END, false,
         CASE WHEN o2.below IS NULL THEN [(0, 0, o2.ord), (0, 0, o2.ord)]
              ELSE [(0, 0, o2.below), CASE WHEN m1.cord IS NULL THEN (1, 0, o2.ord) ELSE (0, 0, m1.cord) END, (0, 0, o2.ord)] END
  FROM o2 JOIN cat k ON k.symbol = o2.tbw LEFT JOIN m1 ON m1.task_id = o2.task_id AND m1.tbw = o2.tbw
  UNION ALL  -- methods t.b.w(..) of t.b that no moved owner replaced
  SELECT m1.task_id, m1.tbw, m1.tbw, k.kind, CASE k.signature WHEN '(a, b=2, *args, **kw)' THEN '(a)' ELSE k.signature END,
         CASE WHEN k.kind = 'constant' THEN k.value END, false, [(0, 0, o1.ord), (0, 0, m1.cord)]
  FROM m1 JOIN o1 USING (task_id, tb) JOIN cat k ON k.symbol = m1.tbw
  WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.task_id = m1.task_id AND o2.tbw = m1.tbw)
  UNION ALL  -- functions
  SELECT task_id, fn, fn, 'callable', '(q, r=None)', NULL, false, [(0, 1, min(ord))] FROM c WHERE r = 2 GROUP BY 1, 2
  UNION ALL  -- not in the catalog
  SELECT task_id, lost, lost, NULL, NULL, NULL, false, [(0, 1, min(ord))] FROM c WHERE r = 3 GROUP BY 1, 2)
SELECT task_id, full_name, name, type, signature, value,
       CASE WHEN NOT bare THEN {_JSON_SQL} END AS parameters_json, row_number() OVER (ORDER BY task_id, dfs) - 1 AS id_num
FROM n
"""


@query("build_api_info", _TREE_SQL)
def q_build_api_info(spark, sf):
    """D2, D6-D11, B5, B6, E7, E8 and B2 over the node maps: rows numbered depth first."""
    out = flows.number_rows(tree.build_api_info(task_calls(spark, sf), catalog(spark, sf)))
    return out.select("task_id", "full_name", "name", "type", "signature", "value", "parameters_json", "id_num")


@query("assign_id_num_wide", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
       row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS id_num
FROM lineitem
""")
def q_assign_id_num_wide(spark, sf):
    """B2 over rows with many payload columns."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                             "l_extendedprice", "l_returnflag", "l_linestatus")
    return assign_id_num(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
