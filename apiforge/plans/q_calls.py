"""Checked queries for call extraction and resolution.

The driver tables hold no source code, so a code corpus is rendered from
``part``: one file per part row, one of three templates chosen by
``p_size % 3``, with the row's size, name and brand filled in.  The oracle
is the closed form of what each template must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators import scan, sites
from ..session import stage
from .registry import query, table

_CODE_SQL = r"""
CASE p_size % 3
  WHEN 0 THEN 'import numpy as np' || chr(10) || 'from collections import Counter' || chr(10) ||
              'v = np.array(' || p_size || ')' || chr(10) || 'c = Counter(v)' || chr(10) ||
              'print(v.mean())' || chr(10) || 'helper.run(v)' || chr(10) || 'def go():' || chr(10) ||
              '    return model.fit(v)' || chr(10) || 'model = Model(' || p_size || ')' || chr(10) ||
              'r = np.random.rand(' || p_size || ')' || chr(10)
  WHEN 1 THEN 'import zipfile' || chr(10) || 'with zipfile.ZipFile(''' || p_name || ''', ''r'') as z:' || chr(10) ||
              '    z.extractall()' || chr(10)
  ELSE 'import pandas as pd' || chr(10) || 'from http.server import BaseHTTPRequestHandler' || chr(10) ||
       'class H' || p_size || '(BaseHTTPRequestHandler):' || chr(10) || '    def g(self):' || chr(10) ||
       '        return self.path' || chr(10) || 'df = pd.read_csv(''' || p_brand || ''')' || chr(10) ||
       'df = df.dropna()' || chr(10) || 'print(pd.read_csv(''' || p_brand || ''').head())' || chr(10)
END"""

_SRC_SQL = f"src AS (SELECT 'T/' || p_partkey AS task_id, p_size AS s, p_name, p_brand, p_size % 3 AS t, {_CODE_SQL} AS code FROM part)"

# Expected calls per template: (template, key, call, line, col, key is API)
_EXPECTED_SQL = """
expected AS (
  SELECT task_id, 'np.array' AS api_key, 'numpy.array(' || s || ')' AS api_call, 3 AS line, 4 AS col_offset, true AS key_is_api FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'Counter', 'collections.Counter(v)', 4, 4, true FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'v.mean', 'numpy.array(' || s || ').mean()', 5, 6, true FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'helper.run', 'helper.run(v)', 6, 0, false FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'model.fit', 'Model(' || s || ').fit(v)', 8, 11, false FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'np.random.rand', 'numpy.random.rand(' || s || ')', 10, 4, true FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'np.random', 'numpy.random', 10, 4, true FROM src WHERE t = 0
  UNION ALL SELECT task_id, 'zipfile.ZipFile', 'zipfile.ZipFile(''' || p_name || ''', ''r'')', 2, 5, true FROM src WHERE t = 1
  UNION ALL SELECT task_id, 'z.extractall', 'zipfile.ZipFile.extractall()', 3, 4, true FROM src WHERE t = 1
  UNION ALL SELECT task_id, 'http.server.BaseHTTPRequestHandler.path', 'http.server.BaseHTTPRequestHandler.path', 5, 15, true FROM src WHERE t = 2
  UNION ALL SELECT task_id, 'pd.read_csv', 'pandas.read_csv(''' || p_brand || ''')', 6, 5, true FROM src WHERE t = 2
  UNION ALL SELECT task_id, 'df.dropna', 'pandas.read_csv(''' || p_brand || ''').dropna()', 7, 5, true FROM src WHERE t = 2
  UNION ALL SELECT task_id, 'pd.read_csv(''' || p_brand || ''').head', 'pandas.read_csv(''' || p_brand || ''').head()', 8, 6, true FROM src WHERE t = 2
)"""


def corpus(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("T/"), F.col("p_partkey").cast("string")).alias("task_id"),
                    F.expr(_CODE_SQL).alias("code"))


def facts(spark, sf):
    return scan.scan_code_facts(corpus(spark, sf))


def calls(spark, sf):
    return R.extract_calls(facts(spark, sf))


@query("extract_calls", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT task_id, api_key, api_call, line, col_offset, key_is_api FROM expected
""")
def q_extract_calls(spark, sf):
    return calls(spark, sf).select("task_id", "api_key", "api_call", "line", "col_offset", "key_is_api")


@query("non_api_calls", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT task_id, api_key, api_call, line, col_offset FROM expected WHERE NOT key_is_api
""")
def q_non_api(spark, sf):
    return sites.non_api(calls(spark, sf)).select("task_id", "api_key", "api_call", "line", "col_offset")


@query("variable_map", f"""
WITH {_SRC_SQL}
SELECT task_id, 'v' AS var, 'numpy.array(' || s || ')' AS text FROM src WHERE t = 0
UNION ALL SELECT task_id, 'c', 'collections.Counter(v)' FROM src WHERE t = 0
UNION ALL SELECT task_id, 'model', 'Model(' || s || ')' FROM src WHERE t = 0
UNION ALL SELECT task_id, 'r', 'numpy.random.rand(' || s || ')' FROM src WHERE t = 0
UNION ALL SELECT task_id, 'z', 'zipfile.ZipFile' FROM src WHERE t = 1
UNION ALL SELECT task_id, 'df', 'pandas.read_csv(''' || p_brand || ''').dropna()' FROM src WHERE t = 2
""")
def q_variable_map(spark, sf):
    return R.variable_map(R.resolve_bindings(facts(spark, sf)))


@query("longest_call_per_position", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT task_id, line, col_offset, api_key, api_call FROM expected
WHERE key_is_api AND NOT (api_key = 'np.random')
""")
def q_longest(spark, sf):
    return sites.longest_call_per_position(sites.api_calls(calls(spark, sf))) \
                .select("task_id", "line", "col_offset", "api_key", "api_call")


@query("group_by_position", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT task_id, line, col_offset, count(*) AS n_entries,
       string_agg(api_key || '=' || api_call, ' | ' ORDER BY api_key DESC) AS entries
FROM expected WHERE key_is_api GROUP BY task_id, line, col_offset
""")
def q_group_by_position(spark, sf):
    g = sites.group_by_position(sites.api_calls(calls(spark, sf)))
    return g.select("task_id", "line", "col_offset", F.size("entries").cast("long").alias("n_entries"),
                    F.array_join(F.transform(F.sort_array("entries", asc=False),
                                             lambda e: F.concat(e["api_key"], F.lit("="), e["api_call"])),
                                 " | ").alias("entries"))


@query("task_call_list", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT DISTINCT task_id, api_call, split_part(api_call, '.', 1) AS segment, length(api_call) AS length
FROM expected WHERE key_is_api
""")
def q_task_call_list(spark, sf):
    lst = sites.task_call_list(sites.api_calls(calls(spark, sf)))
    return lst.select("task_id", "api_call", F.col("ord.seg").alias("segment"),
                      (-F.col("ord.neg_len")).cast("long").alias("length"))


@query("task_call_arrays", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL},
d AS (SELECT DISTINCT task_id, api_call FROM expected WHERE key_is_api)
SELECT task_id, count(*) AS n_calls,
       string_agg(api_call, chr(10) ORDER BY split_part(api_call, '.', 1), length(api_call) DESC, api_call) AS calls
FROM d GROUP BY task_id
""")
def q_task_call_arrays(spark, sf):
    lst = sites.task_call_arrays(sites.task_call_list(sites.api_calls(calls(spark, sf))))
    return lst.select("task_id", F.size("calls").cast("long").alias("n_calls"),
                      F.array_join("calls", "\n").alias("calls"))


@query("inverted_index", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT DISTINCT api_call, task_id FROM expected WHERE key_is_api
""")
def q_inverted_index(spark, sf):
    return sites.inverted_index(sites.api_calls(calls(spark, sf))).select("api_call", "task_id")


@query("api_task_counts", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT api_call, count(DISTINCT task_id) AS n_tasks FROM expected WHERE key_is_api GROUP BY api_call
""")
def q_api_task_counts(spark, sf):
    return sites.api_task_counts(sites.api_calls(calls(spark, sf)))


@query("vocabulary", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL}
SELECT DISTINCT api_call, split_part(api_call, '.', 1) AS segment FROM expected WHERE key_is_api
""")
def q_vocabulary(spark, sf):
    return sites.vocabulary(sites.api_calls(calls(spark, sf)))


@query("flag_low_coverage", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL},
n AS (SELECT task_id, count(DISTINCT api_call) AS n_calls FROM expected WHERE key_is_api GROUP BY task_id)
SELECT s.task_id, coalesce(n.n_calls, 0) AS n_calls FROM src s LEFT JOIN n USING (task_id)
WHERE coalesce(n.n_calls, 0) < 3
""")
def q_flag_low_coverage(spark, sf):
    return sites.flag_low_coverage(corpus(spark, sf), sites.api_calls(calls(spark, sf)))


@query("annotate_sites", f"""
WITH {_SRC_SQL}
SELECT task_id, CASE t
  WHEN 0 THEN replace(replace(replace(replace(code, 'v = np.array(', 'v = &&np.array&&('),
                 'c = Counter(v)', 'c = &&Counter&&(v)'), 'print(v.mean())', 'print(&&v.mean&&())'),
                 'r = np.random.rand(', 'r = &&np.random.rand&&(')
  WHEN 1 THEN replace(replace(code, 'with zipfile.ZipFile(', 'with &&zipfile.ZipFile&&('),
                 '    z.extractall()', '    &&z.extractall&&()')
  ELSE replace(replace(replace(code, 'df = pd.read_csv(', 'df = &&pd.read_csv&&('),
                 'df = df.dropna()', 'df = &&df.dropna&&()'),
                 'print(pd.read_csv(''' || p_brand || ''').head())',
                 'print(&&pd.read_csv(''' || p_brand || ''').head&&())')
  END AS code
FROM src
""")
def q_annotate_sites(spark, sf):
    c = corpus(spark, sf)
    pos = sites.longest_call_per_position(sites.api_calls(calls(spark, sf)))
    return sites.annotate_sites(c, pos)


_AGAIN_SQL = r"""
CASE p_size % 3
  WHEN 0 THEN 'import numpy as m' || chr(10) || 'm.zeros(' || p_size || ')' || chr(10) || 'import math as m' || chr(10) || 'm.floor(' || p_size || ')' || chr(10)
  WHEN 1 THEN 'try:' || chr(10) || '    import simplejson as json' || chr(10) || 'except ImportError:' || chr(10) || '    import json' || chr(10) ||
              'json.loads(''' || p_name || ''')' || chr(10)
  ELSE 'from a.b import f' || chr(10) || 'f(' || p_size || ')' || chr(10) || 'from c import f' || chr(10) || 'import a' || chr(10) || 'f()' || chr(10)
END"""


@query("import_map", f"""
WITH src AS (SELECT 'T/' || p_partkey AS task_id, p_size AS s, p_size % 3 AS t, p_name FROM part)
SELECT task_id, 'm.zeros' AS api_key, 'numpy.zeros(' || s || ')' AS api_call, false AS key_is_api FROM src WHERE t = 0
UNION ALL SELECT task_id, 'm.floor', 'math.floor(' || s || ')', true FROM src WHERE t = 0
UNION ALL SELECT task_id, 'json.loads', 'json.loads(''' || p_name || ''')', true FROM src WHERE t = 1
UNION ALL SELECT task_id, 'f', 'a.b.f(' || s || ')', true FROM src WHERE t = 2
UNION ALL SELECT task_id, 'f', 'c.f()', true FROM src WHERE t = 2
""")
def q_import_map(spark, sf):
    """C5 with aliases that are imported twice: calls count by what the names stand for at the end of the file."""
    p = table(spark, sf, "part")
    code = p.select(F.concat(F.lit("T/"), F.col("p_partkey").cast("string")).alias("task_id"), F.expr(_AGAIN_SQL).alias("code"))
    out = R.extract_calls(scan.scan_code_facts(code))
    return out.select("task_id", "api_key", "api_call", "key_is_api")


@query("posting_lists", f"""
WITH {_SRC_SQL}, {_EXPECTED_SQL},
d AS (SELECT DISTINCT CASE WHEN api_call LIKE 'numpy.array(%)' THEN 'numpy.array' ELSE api_call END AS api_call, task_id FROM expected WHERE key_is_api),
n AS (SELECT *, row_number() OVER (PARTITION BY api_call ORDER BY task_id) - 1 AS i, count(*) OVER (PARTITION BY api_call) AS c FROM d)
SELECT api_call, i // 20 AS block, (any_value(c) + 19) // 20 AS n_blocks, string_agg(task_id, ',' ORDER BY i) AS tasks FROM n GROUP BY 1, 2
""")
def q_posting_lists(spark, sf):
    """C10's lists in blocks of 20 tasks; the arguments of one call are cut, so that a third of all tasks share it."""
    idx = sites.inverted_index(sites.api_calls(calls(spark, sf)))
    same = F.when(F.col("api_call").rlike(r"^numpy\.array\(.*\)$"), "numpy.array").otherwise(F.col("api_call"))
    blocks = sites.list_blocks(idx.select(same.alias("api_call"), "task_id").distinct(), "api_call", "task_id", ["task_id"], size=20)
    return blocks.select("api_call", "block", "n_blocks", F.array_join("items", ",").alias("tasks"))

_SELF_SQL = r"""
CASE p_size % 4
  WHEN 0 THEN 'import conf as Base' || chr(10) || 'class Base(object):' || chr(10) || '    def g(self):' || chr(10) || '        return self.item' || p_size || chr(10)
  WHEN 1 THEN 'import pkg' || chr(10) || 'K = pkg.make(' || p_size || ')' || chr(10) || 'class K:' || chr(10) || '    def g(self):' || chr(10) ||
              '        return self.run()' || chr(10)
  WHEN 2 THEN 'from http import Server' || chr(10) || 'from web import P' || chr(10) || 'class P(Server):' || chr(10) || '    def g(self):' || chr(10) ||
              '        return self.path.join(' || p_size || ')' || chr(10)
  ELSE 'class Q:' || chr(10) || '    def g(self):' || chr(10) || '        return self.go()' || chr(10) || 'Q = Q(' || p_size || ')' || chr(10)
END"""


@query("self_through_names", f"""
WITH src AS (SELECT 'T/' || p_partkey AS task_id, p_size AS s, p_size % 4 AS t FROM part)
SELECT task_id, 'object.item' || s AS api_key, 'conf.item' || s AS api_call FROM src WHERE t = 0
UNION ALL SELECT task_id, 'pkg.make', 'pkg.make(' || s || ')' FROM src WHERE t = 1
UNION ALL SELECT task_id, 'K.run', 'pkg.make(' || s || ').run()' FROM src WHERE t = 1
UNION ALL SELECT task_id, 'http.Server.path.join', 'web.P.path.join(' || s || ')' FROM src WHERE t = 2
UNION ALL SELECT task_id, 'http.Server.path', 'web.P.path' FROM src WHERE t = 2
UNION ALL SELECT task_id, 'Q.go', 'Q(' || s || ').go()' FROM src WHERE t = 3
""")
def q_self_through_names(spark, sf):
    """C4 in classes whose own name is an imported module, a variable, an imported name, or made an object later."""
    p = table(spark, sf, "part")
    code = p.select(F.concat(F.lit("T/"), F.col("p_partkey").cast("string")).alias("task_id"), F.expr(_SELF_SQL).alias("code"))
    refs, _ = R.resolve_references(stage(scan.scan_code_facts(code), "facts"))      # several lookups read them
    return R.dedupe_key_calls(refs).select("task_id", "api_key", "api_call")
