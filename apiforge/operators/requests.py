"""Sample requests: selection (B3, B4), prompts (F1-F6) and resumable plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P


# ---------------------------------------------------------------- selection

def filter_id_range(df: DataFrame, low: int, high: int, *, col: str = "id_num") -> DataFrame:
    """Keep ``low <= id_num < high`` (needs ``low < high``); pushed to the scan."""
    if not low < high:
        raise ValueError("id_range must be increasing")
    return df.where((F.col(col) >= low) & (F.col(col) < high))


def skip_classes(df: DataFrame) -> DataFrame:
    """The type-annotation stage skips ``type = 'class'`` (null-safe) and
    drops the ``type`` field of the rest."""
    return df.where(~F.col("type").eqNullSafe("class")).drop("type")


# ---------------------------------------------------------------- prompts

def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders with column values by ``concat``."""
    pieces = []
    for p in P.split_template(template, *values):
        pieces.append(values[p[0]] if isinstance(p, tuple) else F.lit(p))
    return F.concat(*pieces)


def render_positive(df: DataFrame, *, api: str = "api_json") -> DataFrame:
    """rephrase prompt (api schema) and the assistant prefix."""
    return (df.withColumn("prompt", fill(P.POSITIVE_TEMPLATE, api=F.col(api)))
              .withColumn("response_prefix",
                          F.lit(P.response_prefix(P.SCHEMA, P.RESPONSE_TEMPLATE))))


def render_negative(df: DataFrame, *, api: str = "api_json", example: str = "example") -> DataFrame:
    """contrast prompt (api + code example it must not apply to)."""
    return (df.withColumn("prompt", fill(P.NEGATIVE_TEMPLATE, api=F.col(api),
                                         example=F.col(example)))
              .withColumn("response_prefix",
                          F.lit(P.response_prefix(P.SCHEMA, P.RESPONSE_TEMPLATE))))


def render_type_inference(df: DataFrame, *, api: str = "api_json",
                          example: str = "example") -> DataFrame:
    """return-type prompt; ``api`` is the node without its ``type``."""
    return (df.withColumn("prompt", fill(P.TYPE_INFERENCE_TEMPLATE, api=F.col(api),
                                         example=F.col(example)))
              .withColumn("response_prefix",
                          F.lit(P.response_prefix(P.TYPE_SCHEMA, P.TYPE_RESPONSE_TEMPLATE, "\n"))))


def render_generic(df: DataFrame, *, call: str = "api_call") -> DataFrame:
    """prompt for unresolved calls (no schema): the call text itself."""
    return (df.withColumn("prompt", fill(P.POSITIVE_UNKNOWN_TEMPLATE, api=F.col(call)))
              .withColumn("response_prefix",
                          F.lit(P.response_prefix(P.SCHEMA, P.RESPONSE_TEMPLATE))))


def attach_examples(schemas: DataFrame, corpus: DataFrame, *, strict: bool = True,
                    code_col: str = "code") -> DataFrame:
    """add the task's source code as ``example``.

    A schema row whose task is missing from the corpus fails the job
    (``strict``) or is dropped.  The join is a plain equi join on task_id:
    AQE picks broadcast only if the corpus side is measured small, and splits
    a task that owns a large share of the schema rows (skew join).
    """
    c = corpus.select(F.col("task_id").alias("_t"), F.col(code_col).alias("example"))
    how = "left" if strict else "inner"
    j = schemas.join(c, schemas["task_id"] == c["_t"], how)
    if strict:
        j = j.withColumn("example", F.when(F.col("_t").isNull(),
                                           F.raise_error(F.concat(F.lit("no example for task "),
                                                                  F.col("task_id"))))
                         .otherwise(F.col("example")))
    return j.drop("_t")


def service_suffix(json_format: bool = True, name: Column | None = None) -> Column:
    """What follows the prompt in the service form.

    JSON answers: schema, then the response template up to its answer fence.  Text answers (the
    type stage): schema, a line break, and the whole response template with its mark and the api's name.
    """
    if json_format:
        return F.lit(P.SCHEMA + P.RESPONSE_TEMPLATE.split("```json")[0])
    return F.concat(F.lit(P.TYPE_SCHEMA + "\n"),
                    fill(P.TYPE_RESPONSE_TEMPLATE, _MAGIC_SPLITTER_=F.lit(P.MAGIC_SPLITTER),
                         name=F.lit("") if name is None else name))


def assemble_chat(df: DataFrame, *, prompt: str = "prompt", prefix: str = "response_prefix",
                  service: bool = False, json_format: bool = True, name: str | None = None) -> DataFrame:
    """chat messages.

    Local form: user prompt + assistant prefix (the text before the splitter).
    Service form: system + user, where the user text is the prompt, a newline
    and ``service_suffix``; the system text depends on the answer format (``name``: the
    column with the api's name, for text answers).
    """
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    if not service:
        msgs = F.array(role("user", F.col(prompt)), role("assistant", F.col(prefix)))
    else:
        system = P.SYSTEM_JSON if json_format else P.SYSTEM_TEXT
        user = F.concat(F.col(prompt), F.lit("\n"), service_suffix(json_format, F.col(name) if name else None))
        msgs = F.array(role("system", F.lit(system)), role("user", user))
    return df.withColumn("messages", msgs)


def chat_transcript(turns: DataFrame, *, key: str = "conv_id", order: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """F6 for long-form chat rows: one ordered message array per conversation.

    One group per conversation (bounded by its length); sorting happens on
    the collected array, not by a global sort.
    """
    return (turns.groupBy(key)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"),
                                                           F.col(role).alias("role"),
                                                           F.col(text).alias("content"))))
                      .alias("_m"))
                 .select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                   m["content"].alias("content")))
                         .alias("messages")))


# ---------------------------------------------------------------- resumable plans

def existing_counts(samples: DataFrame, keys=("id_num", "task_id")) -> DataFrame:
    """samples already collected per (id_num, task_id); partial aggregation."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_existing"))


def plan_counts(schemas: DataFrame, existing: DataFrame | None, n_samples: int, *,
                resume: bool = True, keys=("id_num", "task_id")) -> DataFrame:
    """F8 (compact): ``n_existing`` and ``n_missing`` per schema row.

    With ``resume=False`` nothing on disk counts and every row is planned again.
    """
    keys = list(keys)
    if resume and existing is not None:
        j = schemas.join(existing_counts(existing, keys), keys, "left")
        ex = F.coalesce(F.col("n_existing"), F.lit(0)).cast("long")
    else:
        j = schemas
        ex = F.lit(0).cast("long")
    return (j.withColumn("n_existing", ex)
             .withColumn("n_missing", F.greatest(F.lit(n_samples) - ex, F.lit(0)).cast("long")))


def plan_remaining(schemas: DataFrame, existing: DataFrame | None, n_samples: int, *,
                   resume: bool = True, keys=("id_num", "task_id")) -> DataFrame:
    """F8: one row per sample still to make, ``k`` = its index in ``[n_existing, n)``.

    ``explode(sequence)`` emits at most ``n_samples`` rows per schema row,
    after the join, so prompts are rendered once per request row later on.
    """
    c = plan_counts(schemas, existing, n_samples, resume=resume, keys=keys)
    return (c.where(F.col("n_missing") > 0)
             .withColumn("k", F.explode(F.sequence(F.col("n_existing"),
                                                   F.lit(n_samples - 1).cast("long"))))
             .drop("n_missing"))


def plan_batches(counts: DataFrame, batch_size: int) -> DataFrame:
    """rounds of ``min(batch_size, still missing)`` per schema row.

    Works on the compact plan of ``plan_counts``; emits ``batch_no``,
    ``first_k`` and ``n_in_batch``.  No shuffle.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    nb = F.ceil(F.col("n_missing") / F.lit(batch_size)).cast("long")
    return (counts.where(F.col("n_missing") > 0)
                  .withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
                  .withColumn("first_k", F.col("n_existing") + F.col("batch_no") * batch_size)
                  .withColumn("n_in_batch",
                              F.least(F.lit(batch_size).cast("long"),
                                      F.col("n_missing") - F.col("batch_no") * batch_size))
                  .drop("n_missing"))
