"""Nested artefacts, list artefacts, named files, completion rounds, marked lines, import maps."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from apiforge.operators import artefact, complete, resolve, scan, sites, tree
from apiforge.operators import catalog as C
from apiforge.sources import io, task_files


def test_nested_text_goes_out_and_comes_back(spark, tmp_path):
    nested = {"t/1": {"b.K": {"name": "b.K", "type": "class", "signature": "(self)", "chains": {
        "z": {"name": "b.K.z", "type": "callable", "signature": "(a, b=\"é\\n\")", "parameters": {"type": "object", "properties": {"a": {}}}},
        "box": {"chains": {"[0]": {"chains": {"deep": {"name": "b.K.box[0].deep"}}}}}}}, "a": {"name": "a"}},
        "t/2": {}, "t/3": {"a.b": {"name": "first"}, "a": {"name": "top", "chains": {"b": {"name": "last"}, "c": {}}}}}
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in nested.items()], "task_id string, json string")
    io.write_json_texts(rows, "task_id", "json", str(tmp_path / "n"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "n")).collect()]
    assert {k: v for x in lines for k, v in json.loads(x).items()} == nested
    back = artefact.flatten_json(io.read_json_texts(spark, str(tmp_path / "n"), "task_id")).orderBy("task_id", "place").collect()
    # depth first, in the order of the text; of two nodes of one name the last in the place of the first; empty ones go
    assert [(r.task_id, r.full_name, r.name) for r in back] == [
        ("t/1", "b.K", "b.K"), ("t/1", "b.K.z", "b.K.z"), ("t/1", "b.K.box.[0].deep", "b.K.box[0].deep"), ("t/1", "a", "a"),
        ("t/3", "a.b", "last"), ("t/3", "a", "top")]
    assert back[1].signature == "(a, b=\"é\\n\")" and json.loads(back[1].parameters_json) == {"type": "object", "properties": {"a": {}}}


def schemas(spark, calls, symbols):
    cat = spark.createDataFrame([(s, k, g, None) for s, k, g in symbols], "symbol string, kind string, signature string, value string")
    rows = spark.createDataFrame([("t", i, c) for i, c in enumerate(calls)], "task_id string, ord long, api_call string")
    return tree.attach_schemas(tree.nest_nodes(tree.build_nodes(rows, cat)))


def test_a_container_stands_where_its_first_node_was_put(spark):
    symbols = [("m", "module", None), ("m.K", "class", "(self)"), ("m.K.x", "class", None), ("m.K.x.y", "class", "(self)"),
               ("m.K.x.y.go", "callable", "(self)"), ("m.K.run", "callable", "(self)")]
    s = schemas(spark, ["m.K.x.y.go()", "m.K.run()"], symbols)
    got = json.loads(artefact.nested_json(s).collect()[0]["json"])
    assert list(got) == ["m.K"] and list(got["m.K"]["chains"]) == ["run", "x"]
    assert list(got["m.K"]["chains"]["x"]) == ["chains"] and list(got["m.K"]["chains"]["x"]["chains"]["y"]["chains"]) == ["go"]
    flat = tree.flatten_nodes(tree.depth_first(s)).orderBy("dfs").collect()
    assert [r.full_name for r in flat] == ["m.K", "m.K.run", "m.K.x.y", "m.K.x.y.go"]       # B6: no row for x


def test_tasks_without_nodes_are_empty_objects(spark):
    s = schemas(spark, ["lost()"], [("m", "module", None)])
    tasks = spark.createDataFrame([("t",), ("u",)], "task_id string")
    got = {r.task_id: json.loads(r["json"]) for r in artefact.nested_json(s, tasks).collect()}
    assert got == {"t": {"lost()": {"name": "lost()"}}, "u": {}}
    assert artefact.nested_json(s.limit(0)).collect() == []


def test_paths_are_parsed_once_per_plan(spark):
    cat = spark.createDataFrame([("m", "module", None, None)], "symbol string, kind string, signature string, value string")
    calls = spark.createDataFrame([("m.f(1)",)], "api_call string")
    plan = C.resolve_calls(calls, cat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_list_artefact_lines_make_one_object(spark, tmp_path, size):
    lists = {f"call{k}(\"é\")": [f"T/{i}" for i in range(n)] for k, n in enumerate([1, 2, 3, 7, 50])}
    rows = spark.createDataFrame([(c, t, i) for c, ts in lists.items() for i, t in enumerate(ts)], "api_call string, task_id string, at long")
    blocks = sites.list_blocks(rows.repartition(5), "api_call", "task_id", ["at"], size=size)
    assert blocks.agg(F.max(F.size("items"))).first()[0] <= size
    io.write_list_artefact(blocks, "api_call", str(tmp_path / "lists"))
    files = sorted(f for f in os.listdir(tmp_path / "lists") if f.startswith("part-"))
    text = "".join((tmp_path / "lists" / f).read_text() for f in files)
    assert json.loads(text) == lists


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "code")
    rows = [(f"A/{i}", f"print({i})\n# é") for i in range(25)] + [("B/3", "the larger id"), ("C/none", None), ("C/empty", "")]
    df = spark.createDataFrame(rows, "task_id string, code string").repartition(6)
    assert io.write_annotated_code(df.withColumn("code", F.lit("old")), path) == 27
    (tmp_path / "code" / "other.py").write_text("stays")
    assert io.write_annotated_code(df, path) == 27
    want = {i.split("/")[1] + ".py": t or "" for i, t in rows if i != "A/3"} | {"other.py": "stays"}
    assert {f: (tmp_path / "code" / f).read_text() for f in os.listdir(path)} == want
    with pytest.raises(Exception, match="not a file name"):
        task_files.write_files(spark.createDataFrame([("a/b.py", "x")], "name string, text string"), path)
    assert {f for f in os.listdir(path) if not f.startswith("_")} == set(want)


def test_small_files_are_written_by_many_tasks(spark):
    rows = spark.range(400).select(F.concat("id", F.lit(".py")).alias("name"), F.lit("x").alias("text")).groupBy("name").agg(F.max("text").alias("text"))
    dealt = task_files._dealt(rows).select(F.spark_partition_id().alias("p"), "name")
    assert dealt.select("p").distinct().count() >= 2 * spark.sparkContext.defaultParallelism
    assert dealt.select("name").distinct().count() == dealt.count() == 400


def test_files_are_overwritten_without_a_second_copy(spark, tmp_path):
    """A small file takes a block of the disk, so the files of a second write must not all stand beside those of the first."""
    n, most, done = 2_000, [0], threading.Event()
    rows = spark.range(n).select(F.concat("id", F.lit(".py")).alias("name"), F.lit("old").alias("text"))
    assert task_files.write_files(rows, str(tmp_path)) == n

    def count():
        while not done.is_set():
            most[0] = max(most[0], sum(len(files) for _, _, files in os.walk(tmp_path)))

    counting = threading.Thread(target=count)
    counting.start()
    try:
        assert task_files.write_files(rows.withColumn("text", F.lit("new")), str(tmp_path)) == n
    finally:
        done.set()
        counting.join()
    assert n <= most[0] <= n + 200
    assert sorted(os.listdir(tmp_path)) == sorted(f"{i}.py" for i in range(n))
    assert {(tmp_path / f"{i}.py").read_text() for i in range(n)} == {"new"}
    (tmp_path / "last.py").mkdir()
    (tmp_path / "last.py" / "in the way").write_text("")
    with pytest.raises(Exception, match="in the way|[Dd]irectory"):
        task_files.write_files(spark.createDataFrame([("last.py", "x")], "name string, text string"), str(tmp_path))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_")]


def test_named_files_are_read_many_to_a_task(spark, tmp_path):
    want = {f"{i:03}.py": f"print({i})\n# é" for i in range(130)} | {"_own.py": "", "big.py": "x" * 3_000_000, "bigger.py": "y" * 7_000_000}
    for name, text in (want | {"other.txt": "not read"}).items():
        (tmp_path / name).write_text(text)
    (tmp_path / "folder.py").mkdir()
    back = io.read_annotated_code(spark, str(tmp_path))
    assert back.columns == ["task", "code"] and back.rdd.getNumPartitions() == 1
    assert {r.task: r.code for r in back.collect()} == want
    few = task_files.read_files(spark, f"file://{tmp_path}", ".py", files_per_task=50)
    assert few.rdd.getNumPartitions() == 3 and sorted(r.name for r in few.select("name").collect()) == sorted(want)
    assert task_files.read_files(spark, str(tmp_path), ".none").collect() == []
    (tmp_path / "bad.py").write_bytes(b"\xff")
    with pytest.raises(Exception, match="codec"):
        io.read_annotated_code(spark, str(tmp_path)).collect()


def test_completion_rounds(spark, tmp_path):
    reqs = spark.createDataFrame([(i, "t", f"p{i}") for i in range(6)], "id_num long, task_id string, prompt string")
    have = spark.createDataFrame([(0, "t")] * 7 + [(1, "t")] * 2, "id_num long, task_id string")
    path = str(tmp_path / "rounds")

    def some(batch):
        return [[f"{p}:{n + j}" for j in range(max(1, a // 2))] for p, n, a in zip(batch["prompt"], batch["n_existing"], batch["n_asked"])]

    out = complete.complete_rounds(reqs, some, 5, existing=have, path=path)
    got = sorted((r.id_num, r.k, r.completion) for r in out.collect())
    assert got == [(i, k, f"p{i}:{k}") for i in range(1, 6) for k in range(2 if i == 1 else 0, 5)]     # 0 has enough
    assert out.agg(F.max("round")).first()[0] == 4                                             # 2 of 5, then 1, 1, 1

    def never(batch):
        raise AssertionError("finished rounds are read, not made again")

    again = complete.complete_rounds(reqs, never, 5, existing=have, path=path)
    assert sorted((r.id_num, r.k, r.completion) for r in again.collect()) == got
    with pytest.raises(Exception, match="No outputs from model"):
        complete.complete_rounds(reqs, lambda b: [[] for _ in range(len(b))], 2)
    assert complete.complete_rounds(reqs, never, 0).collect() == []


def test_marks_of_a_long_file_take_linear_time(spark):
    def run(lines):
        code = spark.createDataFrame([("t", "\n".join(f"x{i} = np.f(np.g({i}))" for i in range(lines)))], "task_id string, code string")
        at = spark.range(0, lines, 3).select(
            F.lit("t").alias("task_id"), (F.col("id") + 1).cast("int").alias("line"), F.lit(4).alias("col_offset"), F.lit("np.g").alias("api_key"),
            F.struct(F.col("id").alias("key_first"), F.col("id").alias("seq")).alias("pos_first"), F.col("id").alias("key_first"), F.col("id").alias("seq"))
        begin = time.monotonic()
        got = sites.annotate_sites(code, at).collect()[0]["code"].split("\n")
        took = time.monotonic() - begin
        assert [x for i, x in enumerate(got) if ("&&np.g&&" in x) != (i % 3 == 0)] == []
        return took
    run(50)
    small, large = run(10_000), run(100_000)
    assert large < 30 * max(small, 0.2)


def test_marks_with_gaps(spark):
    code = spark.createDataFrame([("t", "\n".join("f(a)" for _ in range(200))), ("u", "f(a)")], "task_id string, code string")
    lines = [1, 17, 18, 150, 199, 200, 500]
    at = spark.createDataFrame([("t", n, 0, "f", (n, n), n, n) for n in lines],
                               "task_id string, line int, col_offset int, api_key string, pos_first struct<a:int,b:int>, key_first int, seq int")
    got = {r.task_id: r.code.split("\n") for r in sites.annotate_sites(code, at).collect()}
    assert [i + 1 for i, x in enumerate(got["t"]) if x == "&&f&&(a)"] == lines[:-1] and got["u"] == ["f(a)"]


@pytest.mark.parametrize("boundary", [False, True])
def test_an_alias_imported_twice_keeps_one_target(spark, boundary):
    code = "import a.b as m\nm.f()\nimport c as m\nm.g()\nfrom d import e\ne.x()\nimport os\noscar.run()\n"
    facts = scan.scan_code_facts(spark.createDataFrame([("t", code)], "task_id string, code string"))
    assert sorted(resolve.import_targets(facts).first()["targets"]) == ["c", "d.e", "os"]
    got = {r.api_call: r.key_is_api for r in resolve.extract_calls(facts, boundary=boundary).collect()}
    assert got["a.b.f()"] is False and got["c.g()"] is True and got["d.e.x()"] is True
    assert got["oscar.run()"] is (not boundary)            # "os" is a prefix of its letters, not of its path
