"""The nested API artefact out and in (A4, E8): ``{task: {key: {..., "chains": {...}}}}``.

Out: the node rows are assembled from the deepest level up.  A round joins a level with the texts of
its children, grouped by their parent's path in the order of their places, and hands its own texts up; a node
is read and written once, and a round is one join and one grouping.  A task's text is one record, as
the artefact's format demands; nothing larger is ever collected.

In: the texts are opened from the top down.  A round explodes the members of every node's
``chains``; it ends when no node has any.  ``from_json`` into a map of texts keeps the order of the members
(a VARIANT would sort them), and that order is the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..session import stage
from . import tree

#: Members of a node's object, around its ``chains``.
BEFORE, AFTER = ("name", "type", "signature", "value"), ("parameters_json",)


def nested_json(schemas: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """A4: ``(task_id, json)``, one nested object per task, from the rows of ``tree.attach_schemas``.

    Absent fields have no member, containers (paths that only lead to nodes) have ``chains`` only, and the
    parameter schema follows the chains.  ``tasks(task_id)`` adds the tasks without nodes as ``{}``.
    """
    own = schemas.select("task_id", "path", *BEFORE, *AFTER)
    rows = tree.places(schemas).withColumnRenamed("at", "path").join(own, ["task_id", "path"], "left")
    rows = stage(rows.withColumn("_depth", F.size("path")), "artefact-nodes")
    deepest = rows.agg(F.max("_depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = rows.filter(F.col("_depth") == depth)
        if below is None:
            level = level.withColumn("json", F.lit(None).cast("string"))
        else:
            level = level.join(below, ["task_id", "path"], "left")
        node = J.obj(*((c, J.quote(F.col(c))) for c in BEFORE), ("chains", F.col("json")), ("parameters", F.col("parameters_json")))
        member = F.concat(J.quote(F.element_at("path", -1)), F.lit(": "), node)
        level = level.select("task_id", F.slice("path", 1, depth - 1).alias("path"), F.struct("place", member.alias("text")).alias("_m"))
        texts = F.transform(F.sort_array(F.collect_list("_m")), lambda m: m["text"])
        below = stage(level.groupBy("task_id", "path").agg(F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}")).alias("json")),
                      "artefact-level")
    if below is None:
        below = schemas.select("task_id", F.lit("{}").alias("json")).limit(0)
    out = below.select("task_id", "json")
    if tasks is not None:
        out = tasks.select("task_id").distinct().join(out, "task_id", "left").withColumn("json", F.coalesce("json", F.lit("{}")))
    return out


def _members(text) -> F.Column:
    return F.from_json(text, "map<string,string>")


def flatten_json(artefact: DataFrame) -> DataFrame:
    """E8 on nested objects ``(task_id, json)`` of any depth: a row per node with data.

    ``full_name`` joins the keys on the way by dots; of several nodes of one name the last one's fields
    count, in the place of the first.  ``place`` orders the rows of a task depth first, as the objects are
    written.  Containers give no row.  Schemas come back as compact JSON text.
    """
    rounds = []
    level = artefact.select("task_id", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"),
                            F.col("json").alias("chains"))
    while True:
        opened = (level.filter(F.col("chains").isNotNull())
                       .select("task_id", "path", "place", F.posexplode(_members(F.col("chains"))).alias("_i", "_key", "_text"))
                       .select("task_id", F.concat("path", F.array("_key")).alias("path"),
                               F.concat("place", F.array("_i")).alias("place"), _members(F.col("_text")).alias("_x")))
        level = stage(opened.select("task_id", "path", "place", *(F.col("_x")[c].alias(c) for c in BEFORE),
                                    F.col("_x")["parameters"].alias("parameters_json"), F.col("_x")["chains"].alias("chains"),
                                    (F.size(F.map_filter("_x", lambda k, v: k != "chains")) > 0).alias("_data")), "artefact-round")
        if level.isEmpty():
            break
        rounds.append(level)
    every = level
    for r in rounds:
        every = every.unionByName(r)
    fields = [*BEFORE, *AFTER, "_data"]
    last = every.withColumn("full_name", F.array_join("path", ".")).groupBy("task_id", "full_name").agg(
        F.max_by(F.struct(*fields), "place").alias("_n"), F.min("place").alias("place"))
    return last.select("task_id", "full_name", "_n.*", "place").filter("_data").drop("_data")
