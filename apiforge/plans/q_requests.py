"""Checked queries for prompts, completion and collection (F1-F6, F10-F14) and
the JSON sinks (A1, A2, A4, A5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import complete as CMP
from ..operators import requests as RQ
from ..session import checkpoint_dir
from ..sources import io
from .q_samples import N_SAMPLES, _plan_inputs
from .registry import query, table


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fill(template: str, **exprs: str) -> str:
    """The DuckDB form of ``requests.fill``: literal pieces and expressions joined by ``||``."""
    out = []
    for p in P.split_template(template, *exprs):
        out.append(f"({exprs[p[0]]})" if isinstance(p, tuple) else _sql_lit(p))
    return " || ".join(out)


# api node text rendered from labels: canonical JSON of a small node
_API_SQL = """'{"name": "doc' || l.doc_id || '", "type": "' || CASE WHEN l.quality = 1 THEN 'function' ELSE 'class' END || '", "signature": "(x, toxic=' || l.toxic || ')"}'"""


def _api_rows(spark, sf):
    lab = table(spark, sf, "labels")
    api = F.concat(F.lit('{"name": "doc'), F.col("doc_id").cast("string"), F.lit('", "type": "'),
                   F.when(F.col("quality") == 1, "function").otherwise("class"),
                   F.lit('", "signature": "(x, toxic='), F.col("toxic").cast("string"), F.lit(')"}'))
    return lab.select(F.col("doc_id").cast("string").alias("task_id"), F.col("doc_id"), api.alias("api_json"))


def _corpus(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("code"))


@query("render_positive", f"""
SELECT l.doc_id, {sql_fill(P.POSITIVE_TEMPLATE, api=_API_SQL)} AS prompt,
       {_sql_lit(P.response_prefix(P.SCHEMA, P.RESPONSE_TEMPLATE))} AS response_prefix
FROM labels l
""")
def q_render_positive(spark, sf):
    return RQ.render_positive(_api_rows(spark, sf)).select("doc_id", "prompt", "response_prefix")


@query("render_negative", f"""
SELECT l.doc_id, {sql_fill(P.NEGATIVE_TEMPLATE, api=_API_SQL, example='d.text')} AS prompt
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def q_render_negative(spark, sf):
    s = RQ.attach_examples(_api_rows(spark, sf), _corpus(spark, sf))
    return RQ.render_negative(s).select("doc_id", "prompt")


@query("render_type_inference", f"""
SELECT l.doc_id, {sql_fill(P.TYPE_INFERENCE_TEMPLATE, api=_API_SQL, example='d.text')} AS prompt,
       {_sql_lit(P.response_prefix(P.TYPE_SCHEMA, P.TYPE_RESPONSE_TEMPLATE, chr(10)))} AS response_prefix
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
WHERE l.quality = 1
""")
def q_render_type_inference(spark, sf):
    s = RQ.attach_examples(_api_rows(spark, sf), _corpus(spark, sf))
    s = s.withColumn("type", F.when(F.col("api_json").contains('"type": "class"'), "class").otherwise("function"))
    s = RQ.skip_classes(s)
    return RQ.render_type_inference(s).select("doc_id", "prompt", "response_prefix")


@query("render_generic", f"""
SELECT doc_id, {sql_fill(P.POSITIVE_UNKNOWN_TEMPLATE, api="'doc' || doc_id || '.open(' || toxic || ')'")} AS prompt
FROM labels
""")
def q_render_generic(spark, sf):
    lab = table(spark, sf, "labels")
    calls = lab.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".open("),
                                          F.col("toxic").cast("string"), F.lit(")")).alias("api_call"))
    return RQ.render_generic(calls).select("doc_id", "prompt")


@query("assemble_chat", f"""
SELECT l.doc_id, 'user' || ':' || ({sql_fill(P.POSITIVE_TEMPLATE, api=_API_SQL)}) || chr(10) || 'assistant' || ':' ||
       {_sql_lit(P.response_prefix(P.SCHEMA, P.RESPONSE_TEMPLATE))} AS chat,
       'system' || ':' || {_sql_lit(P.SYSTEM_JSON)} || chr(10) || 'user' || ':' ||
       ({sql_fill(P.POSITIVE_TEMPLATE, api=_API_SQL)}) || chr(10) || {_sql_lit(P.SCHEMA + P.RESPONSE_TEMPLATE[:P.RESPONSE_TEMPLATE.index("```json")])} AS service_chat,
       'system' || ':' || {_sql_lit(P.SYSTEM_TEXT)} || chr(10) || 'user' || ':' ||
       ({sql_fill(P.POSITIVE_TEMPLATE, api=_API_SQL)}) || chr(10) || {_sql_lit(P.TYPE_SCHEMA)} || chr(10) ||
       replace(replace({_sql_lit(P.TYPE_RESPONSE_TEMPLATE.replace("{{", "{").replace("}}", "}"))}, '{{_MAGIC_SPLITTER_}}', {_sql_lit(P.MAGIC_SPLITTER)}),
               '{{name}}', 'n' || l.doc_id) AS type_chat
FROM labels l
""")
def q_assemble_chat(spark, sf):
    r = RQ.render_positive(_api_rows(spark, sf))
    local = RQ.assemble_chat(r).withColumn("chat", F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).drop("messages")
    both = RQ.assemble_chat(local, service=True).withColumn("service_chat", F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).drop("messages")
    named = both.withColumn("n", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    typed = RQ.assemble_chat(named, service=True, json_format=False, name="n").withColumn("type_chat", F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))
    return typed.select("doc_id", "chat", "service_chat", "type_chat")


@query("chat_transcript", """
SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
""")
def q_chat_transcript(spark, sf):
    t = RQ.chat_transcript(table(spark, sf, "conversations"))
    return t.select("conv_id", F.size("messages").cast("long").alias("n_turns"),
                    F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])),
                                 "\n").alias("transcript"))


def echo_completion(batch) -> list:
    """Deterministic stand-in for a model: a JSON answer built from the request key."""
    return [f'{{"name": "api_{i}", "type": "function", "k": {k}}}'
            for i, k in zip(batch["id_num"], batch["k"])]


@query("complete_samples", """
WITH schemas AS (SELECT DISTINCT user_id AS id_num, event_type AS task_id FROM events),
existing AS (SELECT user_id AS id_num, event_type AS task_id, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL)
SELECT s.id_num, s.task_id, 'api_' || s.id_num AS api_name,
       '{"name": "api_' || s.id_num || '", "type": "function", "k": ' || k || '}' AS synthesis
FROM schemas s LEFT JOIN existing e USING (id_num, task_id), unnest(range(coalesce(e.n, 0), 10)) AS t(k)
""")
def q_complete_samples(spark, sf):
    schemas, existing = _plan_inputs(spark, sf)
    plan = RQ.plan_remaining(schemas, existing, N_SAMPLES)
    done = CMP.complete(plan, echo_completion, batch_size=64)
    done = done.withColumn("completion", CMP.normalize_completion(CMP.cut_at_stop(F.col("completion"))))
    done = done.withColumn("api_name", F.concat(F.lit("api_"), F.col("id_num").cast("string")))
    return CMP.to_samples(done)


def short_answers(batch) -> list:
    """Deterministic stand-in for a model that answers three fifths of what it is asked, now and then one more."""
    return [[f"{i}/{t}/{asked}/{j}" for j in range(max(1, asked * 6 // 10) + (i % 7 == 0))]
            for i, t, asked in zip(batch["id_num"], batch["task_id"], batch["n_asked"])]


@query("complete_rounds", """
WITH RECURSIVE
schemas AS (SELECT DISTINCT user_id AS id_num, event_type AS task_id FROM events),
existing AS (SELECT user_id AS id_num, event_type AS task_id, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL),
r(id_num, task_id, n, round, asked, got) AS (
  SELECT s.id_num, s.task_id, coalesce(e.n, 0)::BIGINT, 0, 0::BIGINT, 0::BIGINT FROM schemas s LEFT JOIN existing e USING (id_num, task_id)
  UNION ALL
  SELECT id_num, task_id, n + g, round + 1, a, g
  FROM (SELECT *, greatest(1, a * 6 // 10) + (id_num % 7 = 0)::BIGINT AS g FROM (SELECT *, least(4, 10 - n) AS a FROM r WHERE n < 10)))
SELECT id_num, task_id, round, n - got + j AS k, id_num || '/' || task_id || '/' || asked || '/' || j AS completion
FROM r, unnest(range(got)) AS t(j) WHERE round > 0
""")
def q_complete_rounds(spark, sf):
    """Rounds with a function that returns fewer, and sometimes more, texts than asked for."""
    schemas, existing = _plan_inputs(spark, sf)
    return CMP.complete_rounds(schemas, short_answers, N_SAMPLES, existing=existing, batch_size=4,
                               path=_scratch(spark, "rounds"))


@query("cut_at_stop", r"""
SELECT doc_id, regexp_extract(CASE doc_id % 5 WHEN 0 THEN 'a</s>b' || text WHEN 1 THEN text || '<|endoftext|>z' WHEN 2 THEN 'x' || chr(10) || '```' || chr(10) || text
                              WHEN 3 THEN 'q<|endofmask|></s>' ELSE text END,
                              '^(.*?)(<\|endoftext\|>|<\|endofmask\|>|</s>|\n```\n|$)', 1, 's') AS by_default, replace(CASE WHEN least(nullif(strpos(text, '. '), 0), nullif(strpos(text, chr(10)), 0)) IS NULL THEN text
            ELSE substr(text, 1, least(nullif(strpos(text, '. '), 0), nullif(strpos(text, chr(10)), 0)) - 1) END,
            chr(9), '    ') AS cut
FROM documents
""")
def q_cut_at_stop(spark, sf):
    d = table(spark, sf, "documents")
    answer = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a</s>b"), "text"))
               .when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("<|endoftext|>z")))
               .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("x\n```\n"), "text"))
               .when(F.col("doc_id") % 5 == 3, F.lit("q<|endofmask|></s>")).otherwise(F.col("text")))
    return d.select("doc_id", CMP.cut_at_stop(answer).alias("by_default"),
                    CMP.normalize_completion(CMP.cut_at_stop(F.col("text"), [". ", "\n"])).alias("cut"))


_ANSWER_SQL = """CASE event_type
  WHEN 'click' THEN '{"name": "click_' || user_id || '", "signature": "(k=' || (props->>'k') || ')", "k": ' || (props->>'k') || '}'
  WHEN 'view' THEN chr(10) || ' {"short_description": "viewed ' || (props->>'k') || '", "name": null}'
  WHEN 'error' THEN '{bad ' || props
  ELSE props END"""


@query("fan_out_json_fields", f"""
WITH a AS (SELECT event_id, {_ANSWER_SQL} AS completion FROM events),
items AS (
  SELECT event_id, completion, 0 AS slot, CASE WHEN json_valid(completion) THEN json_extract_string(completion, '$.name') END AS output FROM a
  UNION ALL SELECT event_id, completion, 1, CASE WHEN json_valid(completion) THEN json_extract_string(completion, '$.signature') END FROM a
  UNION ALL SELECT event_id, completion, 2, CASE WHEN json_valid(completion) THEN json_extract_string(completion, '$.short_description') END FROM a
  UNION ALL SELECT event_id, completion, 3, completion FROM a)
SELECT event_id, completion, row_number() OVER (PARTITION BY event_id ORDER BY slot) - 1 AS ordinal, output
FROM items WHERE output IS NOT NULL
""")
def q_fan_out(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    ans = (F.when(F.col("event_type") == "click",
                  F.concat(F.lit('{"name": "click_'), F.col("user_id").cast("string"), F.lit('", "signature": "(k='),
                           k, F.lit(')", "k": '), k, F.lit("}")))
            .when(F.col("event_type") == "view", F.concat(F.lit('\n {"short_description": "viewed '), k,
                                                          F.lit('", "name": null}')))
            .when(F.col("event_type") == "error", F.concat(F.lit("{bad "), F.col("props")))
            .otherwise(F.col("props")))
    out = CMP.fan_out_json_fields(e.select("event_id", ans.alias("completion")))
    return out.select("event_id", "completion", F.col("ordinal").cast("long").alias("ordinal"), "output")


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("jsonl_roundtrip", """
SELECT event_id, user_id, event_type, props FROM events
""")
def q_jsonl_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props",
                                          F.col("value").alias("_private"))
    path = _scratch(spark, "jsonl") + ".gz"
    io.write_jsonl(e, path)
    return io.read_jsonl(spark, path, "event_id long, user_id long, event_type string, props string")


@query("keyed_json_roundtrip", """
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, c_mktsegment FROM customer
""")
def q_keyed_json_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    path = _scratch(spark, "keyed")
    io.write_keyed_json(c, "c_custkey", ["c_name", "c_mktsegment"], path)
    r = io.read_keyed_json(spark, path, "struct<c_name:string,c_mktsegment:string>")
    return r.select("key", "value.c_name", "value.c_mktsegment")


@query("vocabulary_text", """
SELECT DISTINCT p_type || '.' || replace(p_name, ' ', '.') AS value FROM part
""")
def q_vocabulary_text(spark, sf):
    p = table(spark, sf, "part")
    calls = p.select(F.concat(F.col("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
                     .alias("api_call"))
    path = _scratch(spark, "vocab")
    io.write_vocabulary(calls, path)
    return spark.read.text(path)
