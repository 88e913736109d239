"""Checked queries for the nested API artefact (A4, E8; B6, D6, D9, D10).

Every part is a task whose calls follow one of five forms (by size): methods of a class; an owner below its
parent (three levels); an owner below its grandparent, in a container; a subscripted item below its base;
an item of an item, five levels deep.  Its module is named by the brand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artefact, tree
from ..operators.numbering import assign_id_num
from ..sources import io
from .q_requests import _scratch
from .registry import query, table

#: Symbol below the module, kind, signature.
_SYMBOLS = [("", "module", None), (".Box", "class", "(self, x)"), (".Box.run", "callable", "(self, n: int = 0)"),
            (".Box.stop", "callable", "(self)"), (".Box.lid", "class", "(self)"), (".Box.lid.open", "callable", "(self, w)"),
            (".Box.x", "class", "(self)"), (".Box.x.y", "class", "(self)"), (".Box.x.y.go", "callable", "(self, w)"),
            (".make", "callable", "(n)"), (".make[0].go", "callable", "(self, q)"), (".make[0].b", "callable", "(self)"),
            (".make[0].b[1].c", "callable", "(self, z=None)")]
#: The calls of a task by form; ``M`` stands for the module, ``K`` for the part's key.
_FORMS = [["M.Box.run(K)", "M.Box.stop()", "M.make(K)"],
          ["M.Box.lid.open(K)", "M.Box.run(K)"],
          ["M.Box.x.y.go(K)", "M.Box.stop()", "nowhere.at_all(K)"],
          ["M.make(K)", "M.make()[0].go(K)"],
          ["M.make(K)", "M.make()[0].b()[1].c()", "M.make()[0].b(K)"]]


def _inputs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("m"), F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("m"))
    rows = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(k).alias("kind"), F.lit(g).cast("string").alias("signature")) for s, k, g in _SYMBOLS))
    catalog = (p.select("m").distinct().select("m", F.explode(rows).alias("x"))
                .select(F.concat("m", "x.s").alias("symbol"), "x.kind", "x.signature", F.lit(None).cast("string").alias("value")))
    form = F.get(F.array(*(F.array(*(F.lit(c) for c in f)) for f in _FORMS)), (F.col("p_size") % 5).cast("int"))
    calls = p.select(F.concat(F.lit("P/"), F.col("p_partkey").cast("string")).alias("task_id"), "m", "p_partkey", F.posexplode(form).alias("ord", "c"))
    return calls.select("task_id", "ord", F.replace(F.replace("c", F.lit("M"), F.col("m")), F.lit("K"), F.col("p_partkey").cast("string"))
                        .alias("api_call")), catalog


def _schemas(spark, sf):
    return tree.attach_schemas(tree.nest_nodes(tree.build_nodes(*_inputs(spark, sf))))


def _node(name: str, kind: str, sig: str, schema: str | None = None, chains: str | None = None) -> str:
    """SQL text of a node's object; ``M`` in names is the module."""
    text = f'{{"name": "{name}", "type": "{kind}", "signature": "{sig}"'
    text += (f', "chains": {{{chains}}}' if chains else "") + (f', "parameters": {schema}' if schema else "")
    return text + "}"


def _schema(inner: str = "") -> str:
    return f'{{"type": "object", "properties": {{{inner}}}}}'


_RUN = '"run": ' + _node("M.Box.run", "callable", "(self, n: int = 0)", _schema('"n": {"type": "integer", "default": 0}'))
_STOP = '"stop": ' + _node("M.Box.stop", "callable", "(self)", _schema())
_TEXTS = [
    '{"M.Box": ' + _node("M.Box", "class", "(self, x)", _schema('"x": {}'), f"{_RUN}, {_STOP}")
    + ', "M.make": ' + _node("M.make", "callable", "(n)", _schema('"n": {}')) + "}",
    '{"M.Box": ' + _node("M.Box", "class", "(self, x)", _schema('"x": {}'), _RUN + ', "lid": ' + _node(
        "M.Box.lid", "class", "(self)", None, '"open": ' + _node("M.Box.lid.open", "callable", "(self, w)", _schema('"w": {}')))) + "}",
    '{"M.Box": ' + _node("M.Box", "class", "(self, x)", _schema('"x": {}'), _STOP + ', "x": {"chains": {"y": ' + _node(
        "M.Box.x.y", "class", "(self)", None, '"go": ' + _node("M.Box.x.y.go", "callable", "(self, w)", _schema('"w": {}'))) + "}}")
    + ', "nowhere.at_all(K)": {"name": "nowhere.at_all(K)"}}',
    '{"M.make": ' + _node("M.make", "class", "(n)", _schema('"n": {}'), '"[0]": {"chains": {"go": ' + _node(
        "M.make[0].go", "method", "(self, q)", _schema('"q": {}')) + "}}") + "}",
    '{"M.make": ' + _node("M.make", "class", "(n)", _schema('"n": {}'), '"[0]": {"chains": {"b": ' + _node(
        "M.make[0].b", "method", "(self)", None, '"[1]": {"chains": {"c": ' + _node(
            "M.make[0].b[1].c", "method", "(self, z=None)", _schema('"z": {"type": "NoneType", "default": null}')) + "}}") + "}}") + "}",
]
_JSON_SQL = ("replace(replace(CASE p_size % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TEXTS))
             + " END, 'M', 'm' || split_part(p_brand, '#', 2)), 'K', p_partkey::VARCHAR)")


@query("nested_json_out", f"SELECT 'P/' || p_partkey AS task_id, {_JSON_SQL} AS json FROM part")
def q_nested_json_out(spark, sf):
    """The artefact with containers and subscripts, up to five levels."""
    return artefact.nested_json(_schemas(spark, sf), _inputs(spark, sf)[0])


def _rows_sql() -> str:
    """Depth-first rows of each form, read off the objects above by Python's JSON reader."""
    import json

    def walk(members, above):
        for key, node in members.items():
            name = f"{above}.{key}" if above else key
            if set(node) - {"chains"}:
                yield name, node
            yield from walk(node.get("chains", {}), name)

    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"

    out = []
    for form, text in enumerate(_TEXTS):
        for i, (name, node) in enumerate(walk(json.loads(text), "")):
            schema = json.dumps(node["parameters"], separators=(",", ":")) if "parameters" in node else None
            out.append(f"({form}, {i}, {lit(name)}, {lit(node['name'])}, {lit(node.get('type'))}, {lit(node.get('signature'))}, {lit(schema)})")
    return ", ".join(out)


def _filled(c: str) -> str:
    return f"replace(replace({c}, 'M', 'm' || split_part(p_brand, '#', 2)), 'K', p_partkey::VARCHAR) AS {c}"


@query("nested_json_in", f"""
SELECT 'P/' || p_partkey AS task_id, {_filled('full_name')}, {_filled('name')}, type, signature, NULL::VARCHAR AS value, parameters_json,
       row_number() OVER (ORDER BY 'P/' || p_partkey, i) - 1 AS id_num
FROM part JOIN (VALUES {_rows_sql()}) v(form, i, full_name, name, type, signature, parameters_json) ON form = p_size % 5
""")
def q_nested_json_in(spark, sf):
    """The artefact written as keyed JSON lines, read back, flattened and numbered in its order."""
    path = _scratch(spark, "nested")
    io.write_json_texts(artefact.nested_json(_schemas(spark, sf)), "task_id", "json", path)
    rows = artefact.flatten_json(io.read_json_texts(spark, path, "task_id"))
    return assign_id_num(rows, ["task_id", "place"]).drop("place")
