"""Hand-traced cases (FIXTURES.md section 2) on tiny in-memory inputs."""

import json

import pytest
from pyspark.sql import functions as F

from apiforge.functions import signature as S
from apiforge.operators import catalog as C
from apiforge.operators import complete as CMP
from apiforge.operators import curate, requests, resolve, scan, sites, tree


def corpus(spark, *codes):
    return spark.createDataFrame([(f"T/{i}", c) for i, c in enumerate(codes)], "task_id string, code string")


def extract(spark, *codes):
    facts = scan.scan_code_facts(corpus(spark, *codes))
    return facts, resolve.extract_calls(facts)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_g1_aliases_binding_chain(spark):
    code = ("import numpy as np\nfrom collections import Counter\nv = np.array([1, 2])\n"
            "c = Counter(v)\nprint(v.mean())\n")
    facts, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset", "key_is_api") == sorted([
        ("np.array", "numpy.array([1, 2])", 3, 4, True),
        ("Counter", "collections.Counter(v)", 4, 4, True),
        ("v.mean", "numpy.array([1, 2]).mean()", 5, 6, True)])
    vm = resolve.variable_map(resolve.resolve_bindings(facts))
    assert rows(vm, "var", "text") == [("c", "collections.Counter(v)"), ("v", "numpy.array([1, 2])")]


def test_g2_context_manager(spark):
    code = "import zipfile\nwith zipfile.ZipFile(p, 'r') as z:\n    z.extractall()\n"
    facts, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset") == [
        ("z.extractall", "zipfile.ZipFile.extractall()", 3, 4),
        ("zipfile.ZipFile", "zipfile.ZipFile(p, 'r')", 2, 5)]
    vm = resolve.variable_map(resolve.resolve_bindings(facts))
    assert rows(vm, "var", "text") == [("z", "zipfile.ZipFile")]


def test_g3_self_through_base(spark):
    code = ("from http.server import BaseHTTPRequestHandler\nclass H(BaseHTTPRequestHandler):\n"
            "    def g(self):\n        return self.path\n")
    _, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset") == [
        ("http.server.BaseHTTPRequestHandler.path", "http.server.BaseHTTPRequestHandler.path", 4, 15)]


def test_g4_rebinding_sees_older_value(spark):
    code = "import pandas as pd\ndf = pd.read_csv(p)\ndf = df.dropna()\n"
    facts, calls = extract(spark, code)
    got = {r["api_key"]: r["api_call"] for r in calls.collect()}
    assert got["df.dropna"] == "pandas.read_csv(p).dropna()"
    vm = resolve.variable_map(resolve.resolve_bindings(facts))
    assert rows(vm, "var", "text") == [("df", "pandas.read_csv(p).dropna()")]


def test_binding_chain_depth(spark):
    code = ("import pandas as pd\ndf = pd.read_csv(p)\ng = df.groupby(k)\ndf = df.dropna()\n"
            "h = df.x()\nh2 = h.y()\nh3 = h2.z()\n")
    facts, _ = extract(spark, code)
    vm = dict(rows(resolve.variable_map(resolve.resolve_bindings(facts)), "var", "text"))
    assert vm["h"] == "pandas.read_csv(p).dropna().x()"
    assert vm["g"] == "pandas.read_csv(p).groupby(k)"
    assert vm["h3"] == "pandas.read_csv(p).dropna().x().y().z()"


def test_with_binding_after_chain(spark):
    code = "import io\nf = io.open(p)\nwith f.reader(x) as r:\n    r.read()\n"
    facts, calls = extract(spark, code)
    vm = dict(rows(resolve.variable_map(resolve.resolve_bindings(facts)), "var", "text"))
    assert vm["r"] == "io.open"          # cut at the first '(' of the full text
    got = {r["api_key"]: r["api_call"] for r in calls.collect()}
    assert got["r.read"] == "io.open.read()"


def test_g6_api_and_non_api(spark):
    code = "import numpy\nnumpy.a()\nfoo.b()\nsetup.x\n"
    _, calls = extract(spark, code)
    flags = dict(rows(calls, "api_key", "key_is_api"))
    assert flags["numpy.a"] is True
    assert flags["foo.b"] is False
    assert flags["setup.x"] is True      # raw prefix test: builtin type 'set'


def test_g5_longest_per_position(spark):
    calls = spark.createDataFrame(
        [("t", "k1", "numpy.a", 1, 0, 1), ("t", "k1", "numpy.a()", 1, 0, 2), ("t", "k2", "numpy.a()", 1, 0, 3)],
        "task_id string, api_key string, api_call string, line int, col_offset int, seq long")
    out = sites.longest_call_per_position(calls)
    assert rows(out, "api_key", "api_call") == [("k1", "numpy.a()"), ("k2", "numpy.a()")]


def test_g7_marking_sees_earlier_marks(spark):
    c = spark.createDataFrame([("t", "x = np.mean(np.mean(a))")], "task_id string, code string")
    s = spark.createDataFrame([("t", "np.mean", "numpy.mean(np.mean(a))", 1, 4, 1),
                               ("t", "np.mean", "numpy.mean(a)", 1, 12, 2)],
                              "task_id string, api_key string, api_call string, line int, col_offset int, seq long")
    pos = s.withColumn("key_first", F.lit(1)).withColumn("pos_first", F.struct(F.lit(1), F.col("seq")))
    out = sites.annotate_sites(c, pos).collect()[0]["code"]
    assert out == "x = &&&&np.mean&&&&(np.mean(a))"


@pytest.mark.parametrize("sig,expected", [
    ("(a, b: dict[str, int] = None, *args, c='x', d=-1, e=2.5, **kw) -> list[int]",
     '{"type": "object", "properties": {"a": {}, "b": {"type": "dict[str, int]", "default": null}, '
     '"c": {"type": "str", "default": "x"}, "d": {"type": "integer", "default": -1}, '
     '"e": {"type": "float", "default": 2.5}}}'),
    ("(x, shape=(0, 1), /)",
     '{"type": "object", "properties": {"x": {}, "shape": {"type": "str", "default": "(0"}, "1)": {}, "/": {}}}'),
    ("(self, k: 'str | None' = None)",
     '{"type": "object", "properties": {"k": {"type": ["null", "str"], "default": null}}}'),
    ("()", '{"type": "object", "properties": {}}'),
    ("(a=1e-05, b=123456789.5, c=0.0001, d=1-2)",
     '{"type": "object", "properties": {"a": {"type": "str", "default": "1e-05"}, '
     '"b": {"type": "float", "default": 123456789.5}, "c": {"type": "float", "default": 0.0001}, '
     '"d": {"type": "str", "default": "1-2"}}}'),
    ("(p: os.PathLike[str] = 'a', q: 'bool' = False, a=1, a=2)",
     '{"type": "object", "properties": {"p": {"type": "string", "default": "a"}, '
     '"q": {"type": "bool", "default": false}, "a": {"type": "integer", "default": 2}}}'),
])
def test_g8_signature_schema(spark, sig, expected):
    df = spark.createDataFrame([(sig,)], "signature string")
    got = df.select(S.parameter_schema(S.parse_signature(F.col("signature")))).first()[0]
    assert got == expected
    assert json.loads(got) == json.loads(expected)


def test_g8_constant_and_missing(spark):
    df = spark.createDataFrame([("constant", None), ("callable", None), ("callable", "")], "t string, s string")
    got = [r[0] for r in df.select(S.schema_json(F.col("t"), F.col("s"))).collect()]
    assert got == ['{"type": "constant"}', None, None]


def test_py_float_text(spark):
    vals = [0.05, 17.0, 1e-05, 1.5e16, 12345678.0, 0.0001, 1e22, -2.5, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(S.py_float_text(F.col("x"))).collect()]
    assert got == [repr(v) for v in vals]


@pytest.mark.parametrize("sig,call,expected", [
    ("(a, b=1, c=None)", "f(1, c=2)", "(a, c=None)"),
    ("(self, x, y=0)", "o.m(1)", "(self, x)"),
    ("(a, **kw)", "f(1, z=2)", "(a, **kw)"),
    ("(a, b)", "m.CONST", "(a, b)"),
    ("(self, x)", "o.m(1, 2)", "(self, x)"),
])
def test_g9_used_args(spark, sig, call, expected):
    df = spark.createDataFrame([(sig, call)], "signature string, api_call string")
    p = C.call_path(df.select("api_call"))
    j = df.join(p, "api_call")
    got = j.select(F.when(F.col("is_call"), C.used_args(F.col("signature"), F.col("n_pos"), F.col("kws")))
                   .otherwise(F.col("signature"))).first()[0]
    assert got == expected


def _catalog(spark):
    return spark.createDataFrame([
        ("pandas", "module", None, None), ("pandas.DataFrame", "class", "(data=None, index=None)", None),
        ("numpy", "module", None, None), ("numpy.linalg", "module", None, None),
        ("numpy.linalg.inv", "callable", "(a)", None), ("math", "module", None, None),
        ("math.pi", "constant", None, "3.14")], "symbol string, kind string, signature string, value string")


def test_g10_module_owner(spark):
    tc = spark.createDataFrame([("t", "pandas.DataFrame(d)", 0), ("t", "numpy.linalg.inv(a)", 1)],
                               "task_id string, api_call string, ord int")
    out = tree.build_api_info(tc, _catalog(spark))
    assert sorted(r["full_name"] for r in out.collect()) == ["numpy.linalg.inv"]
    kept = tree.build_api_info(tc, _catalog(spark), keep_module_children=True)
    assert sorted(r["full_name"] for r in kept.collect()) == ["numpy.linalg.inv", "pandas.DataFrame"]


def test_resolve_constant_and_unknown(spark):
    calls = spark.createDataFrame([("math.pi",), ("nope.x(1)",), ("numpy.linalg.inv(a, b)",)], "api_call string")
    got = {r["api_call"]: (r["name"], r["type"], r["signature"], r["value"])
           for r in C.resolve_calls(calls, _catalog(spark)).collect()}
    assert got["math.pi"] == ("math.pi", "constant", None, "3.14")
    assert got["nope.x(1)"] == ("nope.x(1)", None, None, None)
    assert got["numpy.linalg.inv(a, b)"] == ("numpy.linalg.inv", "callable", "(a)", None)


def test_g11_resume_plan(spark):
    schemas = spark.createDataFrame([(i, "t") for i in range(4)], "id_num long, task_id string")
    existing = spark.createDataFrame([(1, "t")] * 3 + [(2, "t")] * 10 + [(3, "t")] * 12, "id_num long, task_id string")
    plan = requests.plan_remaining(schemas, existing, 10)
    counts = dict(rows(plan.groupBy("id_num").count(), "id_num", "count"))
    assert counts == {0: 10, 1: 7}
    again = requests.plan_remaining(schemas, existing.unionByName(plan.select("id_num", "task_id")), 10)
    assert again.count() == 0                                    # resume twice: nothing new
    b = requests.plan_batches(requests.plan_counts(schemas, existing, 10), 4)
    assert rows(b.where("id_num = 1"), "batch_no", "n_in_batch") == [(0, 4), (1, 3)]


def test_g12_curation(spark):
    apis = spark.createDataFrame([(1, "function", None), (2, "class", None), (3, None, "error")],
                                 "api_id long, type string, error string")
    samples = spark.createDataFrame(
        [(1, '{"type": "function"}'), (1, '{"type": "function"}'), (1, '{"type": "class"}'),
         (2, '{"type": "class"}'), (3, '{"type": "method"}')], "api_id long, synthesis string")
    out = curate.curate_positive(samples, apis)
    assert rows(out, "api_id", "synthesis") == [(1, '{"type": "function"}'), (2, '{"type": "class"}'),
                                                (3, '{"type": "method"}')]
    missing = curate.check_coverage(samples.where("api_id <> 3"), apis)
    assert [r["api_id"] for r in missing.collect()] == [3]
    with pytest.raises(AssertionError):
        curate.assert_coverage(samples.where("api_id <> 3"), apis)
    assert curate.dedupe_exact(curate.dedupe_exact(samples)).count() == curate.dedupe_exact(samples).count()


def test_g13_fan_out(spark):
    df = spark.createDataFrame([(1, '{"name":"n","signature":"(a)"}'), (2, "{bad")], "id int, completion string")
    out = CMP.fan_out_json_fields(df)
    assert rows(out, "id", "ordinal", "output") == [(1, 0, "n"), (1, 1, "(a)"),
                                                    (1, 2, '{"name":"n","signature":"(a)"}'), (2, 0, "{bad")]


def test_scan_error_rows_are_kept(spark):
    facts = scan.scan_code_facts(corpus(spark, "def (:\n"))
    assert [r["fact"] for r in facts.collect()] == ["error"]


def test_api_and_non_api_partition_keys(spark):
    code = "import numpy as np\nnp.a()\nfoo.b()\n"
    _, calls = extract(spark, code)
    a = {r["api_key"] for r in sites.api_calls(calls).collect()}
    n = {r["api_key"] for r in sites.non_api(calls).collect()}
    assert a and n and not (a & n)


def test_subscript_resolution_and_nesting(spark):
    cat = spark.createDataFrame([
        ("matplotlib", "module", None, None), ("matplotlib.pyplot", "module", None, None),
        ("matplotlib.pyplot.subplots", "callable", "(nrows=1, ncols=1)", None),
        ("matplotlib.pyplot.subplots[1].plot", "method", "(*args, scalex=True)", None)],
        "symbol string, kind string, signature string, value string")
    tc = spark.createDataFrame([("t", "matplotlib.pyplot.subplots[1].plot(x)", 0),
                                ("t", "matplotlib.pyplot.subplots()", 1)],
                               "task_id string, api_call string, ord int")
    out = {r["full_name"]: r for r in tree.build_api_info(tc, cat).collect()}
    assert set(out) == {"matplotlib.pyplot.subplots", "matplotlib.pyplot.subplots.[1].plot"}
    base = out["matplotlib.pyplot.subplots"]
    assert base["type"] == "class"                 # callable base with a subscript child
    item = out["matplotlib.pyplot.subplots.[1].plot"]
    assert (item["name"], item["type"], item["signature"]) == (
        "matplotlib.pyplot.subplots[1].plot", "method", "(*args, scalex=True)")
    assert item["parameters_json"] == '{"type": "object", "properties": {"scalex": {"type": "bool", "default": true}}}'


def test_nesting_order_three_levels(spark):
    # a.b.c comes before a.b: a.b is still a key then, so a.b.c goes below it and moves along
    cat = spark.createDataFrame([
        ("a", "module", None, None), ("a.b", "callable", "(x)", None), ("a.b.c", "callable", "(y)", None),
        ("q", "module", None, None), ("q.r", "callable", "(z)", None)],
        "symbol string, kind string, signature string, value string")
    tc = spark.createDataFrame([("t", "a.b.c(1)", 0), ("t", "a.b(2)", 1), ("t", "q.r.s.t", 2)],
                               "task_id string, api_call string, ord int")
    got = sorted(r["full_name"] for r in tree.build_api_info(tc, cat).collect())
    assert got == ["a.b", "a.b.c", "q.r.s.t"]
    rows = {r["full_name"]: r for r in tree.build_api_info(tc, cat).collect()}
    assert rows["a.b"]["parameters_json"] == '{"type": "object", "properties": {"x": {}}}'


def test_r10_tuple_binding(spark):
    code = "import matplotlib.pyplot as plt\nfig, ax = plt.subplots()\nax.plot(x)\n"
    facts, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset") == [
        ("ax.plot", "matplotlib.pyplot.subplots()[1].plot(x)", 3, 0),
        ("plt.subplots", "matplotlib.pyplot.subplots()", 2, 10)]
    vm = dict(rows(resolve.variable_map(resolve.resolve_bindings(facts)), "var", "text"))
    assert vm == {"fig": "matplotlib.pyplot.subplots()[0]", "ax": "matplotlib.pyplot.subplots()[1]"}


def test_r11_subscript_target_gives_only_the_attribute(spark):
    code = "import flask\napp = flask.Flask(n)\napp.config['K'] = 1\n"
    _, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset") == [
        ("app.config", "flask.Flask(n).config", 3, 0), ("flask.Flask", "flask.Flask(n)", 2, 6)]


def test_r13_with_builtin_function(spark):
    code = "with open(f) as fh:\n    fh.read()\n"
    facts, calls = extract(spark, code)
    assert rows(calls, "api_key", "api_call", "line", "col_offset", "key_is_api") == [
        ("fh.read", "open.read()", 2, 4, False)]


def test_strict_checks_fail_the_job(spark, tmp_path):
    apis = spark.createDataFrame([(1, "function", None)], "api_id long, type string, error string")
    unknown = spark.createDataFrame([(2, '{"type": "function"}')], "api_id long, synthesis string")
    with pytest.raises(Exception):
        curate.validate_type(unknown, apis).collect()
    bad = spark.createDataFrame([(1, "{bad")], "api_id long, synthesis string")
    with pytest.raises(Exception):
        curate.validate_type(bad, apis).collect()
    with pytest.raises(Exception):
        curate.validate_json(bad, "synthesis").collect()
    flagged = curate.validate_json(bad, "synthesis", strict=False).collect()
    assert flagged[0]["json_ok"] is False
    p = tmp_path / "bad.jsonl"
    p.write_text('{"a": 1}\n{oops\n')
    from apiforge.sources import io
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(p), "a long").collect()
    schemas = spark.createDataFrame([("T/9", 0)], "task_id string, id_num long")
    corpus_df = spark.createDataFrame([("T/1", "x")], "task_id string, code string")
    with pytest.raises(Exception):
        requests.attach_examples(schemas, corpus_df).collect()


def test_r5_second_lookup_after_variable(spark):
    code = "from m import f\nx = f()\nimport q as m\nx.g()\n"
    _, calls = extract(spark, code)
    got = {r["api_key"]: r["api_call"] for r in calls.collect()}
    assert got["x.g"] == "q.f().g()"
