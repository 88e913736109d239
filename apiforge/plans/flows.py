"""The three stages end to end, as compositions of the operators.

1. ``extract_stage``: code corpus -> calls, position map, variable map, call
   lists, inverted index, vocabulary, low-coverage tasks.
2. ``describe_stage``: call lists + symbol catalog -> numbered schema rows.
3. ``request_stage`` / ``collect_stage`` / ``curate_stage``: schema rows ->
   prompts -> samples (user completion function) -> curated samples.

Each returns lazy DataFrames; the fact table and the resolved nodes are
written to the checkpoint folder once because several outputs read them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import complete as CMP
from ..operators import curate, numbering, requests, resolve, scan, sites, tree
from ..session import cut_lineage
from ..sources import corpus as CO


def extract_stage(tasks: DataFrame, *, patches: dict | None = None, order_col: str | None = None,
                  boundary: bool = False) -> dict:
    """Stage 1 (A3, B1, C1-C12, B7)."""
    spark = tasks.sparkSession
    corp = CO.load_corpus(tasks, order_col=order_col) if "code" not in tasks.columns else tasks
    if patches:
        corp = CO.apply_patches(corp, CO.patch_table(spark, patches))
    facts = cut_lineage(scan.scan_code_facts(corp))
    refs, bindings = resolve.resolve_references(facts)
    calls = resolve.classify_calls(resolve.dedupe_key_calls(refs), facts, boundary=boundary).drop("is_api")
    calls = cut_lineage(calls)
    api = sites.api_calls(calls)
    positions = sites.longest_call_per_position(api)
    index = sites.inverted_index(api)
    return {
        "corpus": corp,
        "facts": facts,
        "calls": calls,
        "api": api,
        "non_api": sites.non_api(calls),
        "positions": positions,
        "position_groups": sites.group_by_position(api),
        "variables": resolve.variable_map(bindings),
        "call_lists": sites.task_call_list(api),
        "index": index,
        "task_counts": sites.api_task_counts(api),
        "vocabulary": sites.vocabulary(api),
        "low_coverage": sites.flag_low_coverage(corp, api),
        "annotated": sites.annotate_sites(corp, positions),
    }


def describe_stage(call_lists: DataFrame, catalog: DataFrame, *, corpus_order: DataFrame | None = None,
                   **kw) -> DataFrame:
    """Stage 2 (D1-D11, B5, E1-E8, B2): schema rows numbered task by task, depth first.

    ``corpus_order(task_id, task_no)`` gives the order of the tasks (the corpus file's);
    without it tasks go by their id.
    """
    return number_rows(tree.build_api_info(tree.task_calls_with_order(call_lists), catalog, **kw), corpus_order)


def number_rows(rows: DataFrame, corpus_order: DataFrame | None = None) -> DataFrame:
    """B2 in file order: by task (``corpus_order(task_id, task_no)`` or the id), then depth first."""
    if corpus_order is not None:
        rows = rows.join(corpus_order.select("task_id", "task_no"), "task_id", "left")
    else:
        rows = rows.withColumn("task_no", F.lit(0))
    rows = cut_lineage(rows)
    numbered = numbering.assign_id_num(rows, [F.col("task_no").asc_nulls_last(), "task_id", "dfs"])
    return numbered.drop("task_no", "dfs")


def _api_json(schemas: DataFrame, with_type: bool = True) -> F.Column:
    """Canonical JSON of a schema row (V7): present fields only, then the
    parameter schema as nested JSON."""
    payload = F.to_json(F.struct(*(["name"] + (["type"] if with_type else []) + ["signature", "value"])))
    params = F.when(F.col("parameters_json").isNotNull(),
                    F.concat(F.lit(', "parameters": '), F.col("parameters_json"))).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(payload, r"\}$", ""), params, F.lit("}"))


def request_stage(schemas: DataFrame, corpus: DataFrame, *, mode: str = "positive",
                  existing: DataFrame | None = None, n_samples: int = 10, resume: bool = True,
                  id_range: tuple | None = None) -> DataFrame:
    """Stage 3a (B3, B4, F1-F3, F5, F6, F7, F8): one request row per sample to make.

    ``mode`` in positive / negative / type.  The prompt is rendered after the
    plan is exploded only once per schema row (joined back by key).
    """
    s = schemas
    if id_range is not None:
        s = requests.filter_id_range(s, *id_range)
    if mode == "type":
        s = s.withColumn("api_json", _api_json(s, with_type=False))
        s = requests.skip_classes(s)
    else:
        s = s.withColumn("api_json", _api_json(s))
    s = s.withColumn("api_name", F.col("name"))
    if mode in ("negative", "type"):
        s = requests.attach_examples(s, corpus)
    render = {"positive": requests.render_positive, "negative": requests.render_negative,
              "type": requests.render_type_inference}[mode]
    prompts = requests.assemble_chat(render(s))
    plan = requests.plan_remaining(s.select("id_num", "task_id"), existing, n_samples, resume=resume)
    return plan.join(prompts.select("id_num", "task_id", "api_name", "prompt", "response_prefix", "messages"),
                     ["id_num", "task_id"])


def collect_stage(reqs: DataFrame, complete_fn: Callable[[pd.DataFrame], list], *,
                  batch_size: int | None = None, fan_out: bool = False) -> DataFrame:
    """Stage 3b (F10-F14): samples ``(id_num, task_id, api_name, synthesis)``."""
    done = CMP.complete(reqs, complete_fn, keep=("id_num", "task_id", "k", "api_name"), batch_size=batch_size)
    done = done.withColumn("completion", CMP.normalize_completion(CMP.cut_at_stop(F.col("completion"))))
    if fan_out:
        done = CMP.fan_out_json_fields(done).drop("completion").withColumnRenamed("output", "completion")
    return CMP.to_samples(done)


def curate_stage(samples: DataFrame, schemas: DataFrame, *, positive: bool = True,
                 type_map: dict | None = None) -> tuple:
    """Stage 3c (G1-G6): ``(curated, missing)``; samples carry ``api_id = id_num`` (V8)."""
    s = samples.withColumnRenamed("id_num", "api_id")
    if not positive:
        return curate.curate_negative(s), None
    apis = schemas.select(F.col("id_num").alias("api_id"), "type",
                          F.when(~F.col("resolved"), F.lit("unresolved")).alias("error"))
    deduped = curate.dedupe_exact(s)
    return (curate.validate_type(deduped, apis, type_map=type_map),
            curate.check_coverage(deduped, apis))
