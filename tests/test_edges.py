"""Cases at the edges: caps, nesting, brackets, order and duplicates."""

import pytest
from pyspark.sql import functions as F

from apiforge.functions import signature as S
from apiforge.operators import catalog as C
from apiforge.operators import complete as CMP
from apiforge.operators import curate, resolve, scan, sites, tree
from apiforge.operators.numbering import assign_id_num
from apiforge.plans import flows


@pytest.mark.parametrize("partitions, aqe, advisory", [(8, True, None), (64, True, "4k"), (200, False, None)])
def test_numbering_of_wide_rows(spark, partitions, aqe, advisory):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                             "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    if advisory:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("pay", F.repeat(F.lit("x"), 50))
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        got = assign_id_num(rows, order).toPandas()
        assert sorted(got.id_num) == list(range(rows.count()))
        assert (got.sort_values("id_num")["l_orderkey"].diff().dropna() >= 0).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def facts_of(code):
    return scan.scan_source("t", code)


def test_deep_sources_keep_their_facts():
    long_sum = "import os\nos.getcwd()\nx = " + " + ".join(["a"] * 3_000)
    assert any(r["name"] == "os.getcwd" for r in facts_of(long_sum))
    chain = "import os\nos.getcwd()\nb" + ".c()" * 400
    rows = facts_of(chain)
    assert any(r["name"] == "os.getcwd" for r in rows) and sum(r["fact"] == "ref" and r["kind"] == "call" for r in rows) >= 400
    for bad in ("x = " + "-" * 100_000 + "1", "(" * 5_000, "x = (", None, "\0"):
        assert [r["fact"] for r in facts_of(bad)] == ["error"]


@pytest.mark.parametrize("call, args", [
    ("f(a, *b, k=1, **m)", "(a, *b, k=1, **m)"), ("f()", "()"), ("(lambda: x)(1)", "(1)"), ("f(a)(b, (c, d))", "(b, (c, d))"),
    ("f((x for x in y))", "((x for x in y))"), ("f(')(')", "(')(')"), ("(a or b)(2)", "(2)"), ("a.b[0](q=[1, 2])", "(q=[1, 2])")])
def test_argument_text(call, args):
    import ast
    node = ast.parse(call).body[0].value
    assert scan.argument_text(ast.unparse(node), ast.unparse(node.func)) == args


@pytest.mark.parametrize("text, path", [
    ("a.b(1)[0].c", ["a", "b", "[0]", "c"]), ("'x'.join(y)", ["join"]), ("(a + b).c", ["c"]), ("[1, 2].d", ["d"]),
    ("x", ["x"]), ("m[1:2]['k'].n()", ["m", "[1:2]", "['k']", "n"]), ("{1: 2}[1].e", ["[1]", "e"]), ("f(g(h)[0]).z", ["f", "z"])])
def test_path_segments(text, path):
    assert C.call_path_py(text)["path"] == path


def test_long_with_chains_resolve(spark):
    n = 70
    code = "import g\nwith g.h() as x0:\n" + "".join("    " * (i + 1) + f"with x{i}.k() as x{i + 1}:\n" for i in range(15))
    code += "    " * 16 + "pass\n"
    flat = "import g\nwith g.h() as x0, " + ", ".join(f"x{i}.k() as x{i + 1}" for i in range(n)) + ":\n    pass\n"
    corpus = spark.createDataFrame([("deep", code), ("flat", flat)], "task_id string, code string")
    got = {(r.task_id, r["var"]): r.text for r in resolve.resolve_bindings(scan.scan_code_facts(corpus)).collect()}
    assert got["deep", "x15"] == "g.h" + ".k" * 15 and got["flat", f"x{n}"] == "g.h" + ".k" * n


def test_items_and_targets_bind(spark):
    code = "with a() as x, x.b() as y:\n    pass\nself.z = w = c.f()\nd[0] = v = c.g()\n"
    corpus = spark.createDataFrame([("t", code), ("null", None)], "task_id string, code string")
    facts = scan.scan_code_facts(corpus)
    got = {r["var"]: r.text for r in resolve.resolve_bindings(facts).collect()}
    assert got == {"x": "a", "y": "a.b", "w": "c.f()"}
    assert facts.filter("task_id = 'null'").select("fact").collect()[0][0] == "error"


@pytest.mark.parametrize("sig, call, want", [
    ("()", "f()", "()"), ("()", "f(1)", "()"), ("(a, shape=())", "f(1, shape=2)", "(a, shape=())"),
    ("(a, shape=(0, 1))", "f(1, shape=2)", "(a, shape=(0, 1))"), ("(self, x, y=0)", "o.m(1)", "(self, x)"),
    ("(self)", "o.m()", "(self)"), ("(a, *args, k=3)", "f(1, 2, 3)", "(a, *args, k=3)"), ("(a, **kw)", "f(1, z=2)", "(a, **kw)"),
    ("(a, b: dict[str, int]={'x': 1, 'y': (2, 3)}, c=',')", "f(1, b=2, c=3)",
     "(a, b: dict[str, int]={'x': 1, 'y': (2, 3)}, c=',')"),
    ("(a, b) -> tuple[int, str]", "f(1)", "(a)"), ("(a, b)", "m.CONST", "(a, b)"), (None, "f(1)", None),
    ("(self, x)", "o.m(1, 2, 3)", "(self, x)")])
def test_used_args(spark, sig, call, want):
    rows = spark.createDataFrame([(sig, call)], "signature string, api_call string")
    j = rows.join(C.call_path(rows), "api_call")
    assert j.select(C.used_args(F.col("signature"), F.col("n_pos"), F.col("kws"))).first()[0] == want


def test_resolving_an_empty_signature_and_doubled_symbols(spark):
    cat = spark.createDataFrame([("time", "module", None, None), ("time.time", "callable", "()", None),
                                 ("time.time", "callable", "()", None)],
                                "symbol string, kind string, signature string, value string")
    calls = spark.createDataFrame([("time.time()",)], "api_call string")
    got = C.resolve_calls(calls, cat).collect()
    assert [(r.name, r.signature) for r in got] == [("time.time", "()")]


def test_integers_of_any_length(spark):
    sigs = ["(seed=18446744073709551615)", "(n=-0)", "(n=-00012345678901234567890)", "(n=1-2)", "(n=007)"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sigs], "s string").select(
        S.schema_json(F.lit("callable"), F.col("s"))).collect()]
    assert '"default": 18446744073709551615' in got[0] and '"type": "integer"' in got[0]
    assert '"default": 0' in got[1] and '"default": -12345678901234567890' in got[2]
    assert '"default": "1-2"' in got[3] and '"default": 7' in got[4]


CATALOG = [("pandas", "module", None, None), ("pandas.DataFrame", "class", "(data)", None),
           ("pandas.DataFrame.groupby", "callable", "(self, by)", None), ("a", "callable", "(q)", None),
           ("a.b", "callable", "(r)", None)]


def info(spark, calls):
    cat = spark.createDataFrame(CATALOG, "symbol string, kind string, signature string, value string")
    rows = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(calls)], "task_id string, api_call string, ord long")
    return tree.build_api_info(rows, cat)


def test_a_moved_owner_replaces_the_method(spark):
    got = info(spark, [("t", "pandas.DataFrame(d).groupby(k).sum()"), ("t", "pandas.DataFrame(d).groupby(k)")]).collect()
    names = [r.full_name for r in got]
    assert names.count("pandas.DataFrame.groupby") == 1 and len(set(names)) == len(names)


def test_containers_count_as_children_and_rows_go_depth_first(spark):
    cat = spark.createDataFrame([(s, "callable", "(q)", None) for s in ("a", "a.b", "a.b.c", "a.b.c.d", "z")],
                                "symbol string, kind string, signature string, value string")
    rows = spark.createDataFrame([("t", c, i) for i, c in enumerate(["a(1)", "z(1)", "a.b.c.d(1)", "a.b(1)"])] +
                                 [("s", "z(1)", 0)], "task_id string, api_call string, ord long")
    order = spark.createDataFrame([("t", 0), ("s", 1)], "task_id string, task_no int")
    got = flows.describe_stage(rows.withColumn("ord", F.col("ord")), cat, corpus_order=order).orderBy("id_num").collect()
    assert [(r.task_id, r.full_name) for r in got] == [("t", "a"), ("t", "a.b"), ("t", "a.b.c.d"), ("t", "z"), ("s", "z")]
    assert [r.id_num for r in got] == [0, 1, 2, 3, 4]
    schema = {r.full_name: r.parameters_json for r in got if r.task_id == "t"}
    assert schema["a.b"] is None and schema["a.b.c.d"] is not None and schema["a"] is not None


def test_dots_in_arguments_cost_no_rounds(spark):
    got = info(spark, [("t", "foo('" + "." * 5_000 + "')"), ("t", "a(1)")]).collect()
    assert len(got) == 2


def test_json_answers_after_white_space(spark):
    rows = spark.createDataFrame([(0, '\n{"name": "n"}'), (1, "[1]"), (2, "{bad"), (3, '"x"'), (4, None)], "i int, completion string")
    got = {(r.i, r.output) for r in CMP.fan_out_json_fields(rows).collect()}
    assert got == {(0, "n"), (0, '\n{"name": "n"}'), (1, "[1]"), (2, "{bad"), (3, '"x"')}


def test_curation_names_everything_and_aborts(spark):
    apis = spark.createDataFrame([(i, "function", None) for i in range(40)] + [(0, "function", None)],
                                 "api_id int, type string, error string")
    samples = spark.createDataFrame([(0, '{"type": "function"}')], "api_id int, synthesis string")
    assert curate.curate_positive(samples, apis).count() == 1
    with pytest.raises(AssertionError) as e:
        curate.curate_positive(samples, apis, coverage=True)
    assert all(str(i) in str(e.value) for i in range(1, 40))
    untyped = spark.createDataFrame([(0, "{}")], "api_id int, synthesis string")
    with pytest.raises(Exception, match="without a type"):
        curate.validate_type(untyped, apis).collect()
    assert curate.validate_type(untyped, apis, strict=False).collect() == []


def test_marks_stay_in_their_lines(spark):
    corpus = spark.createDataFrame([("t", "x = np.mean(np.mean(a))\ny\n"), ("u", "none"), ("v", None)], "task_id string, code string")
    s = spark.createDataFrame([("t", 1, 1, 0, 1, "np.mean"), ("t", 1, 2, 0, 2, "np.mean")],
                              "task_id string, line int, pos_first int, key_first int, seq int, api_key string")
    got = {r.task_id: r.code for r in sites.annotate_sites(corpus, s).collect()}
    assert got == {"t": "x = &&&&np.mean&&&&(np.mean(a))\ny\n", "u": "none", "v": None}
