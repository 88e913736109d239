"""API node tree per task as adjacency rows.

Node rows: ``(task_id, top STRING, sub ARRAY<STRING>, name, type, signature,
value, resolved, ord)`` where ``top`` is the top-level key of the task's
node map and ``sub`` the path below it (``[]`` for the top node itself,
``[method]`` for a method grouped under its owner).  Nesting (D9/D10) moves
whole top-level keys below other keys; the final path of a node is
``path(top) + sub``.  Order matters in the original (a key that was already
moved no longer counts as a parent), so every key carries ``ord``.

All steps are joins and aggregations keyed by ``task_id`` plus a key; the
nesting needs one round per dot level of the keys that have a parent key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signature as S
from ..session import cut_lineage, stage
from . import catalog as C



def task_calls_with_order(task_lists: DataFrame) -> DataFrame:
    """``(task_id, api_call, ord)`` from the long form of C9 (kept as is) or
    from the list form ``(task_id, calls ARRAY)`` (position as order)."""
    if "calls" in task_lists.columns:
        return task_lists.select("task_id", F.posexplode("calls").alias("ord", "api_call"))
    o = F.col("ord")
    if "seg" in task_lists.schema["ord"].dataType.simpleString():
        # the struct order as one sortable text: segment, then length descending, then text
        o = F.concat(o["seg"], F.lit("\u0000"), F.lpad((F.lit(1 << 30) + o["neg_len"]).cast("string"), 10, "0"),
                     F.lit("\u0000"), o["text"])
    return task_lists.select("task_id", "api_call", o.alias("ord"))


def split_by_owner(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """A call is an object method when its first two segments (before the
    first ``(``) name a class in the catalog; one-segment calls are standalone."""
    segs = F.split(F.split_part(F.col("api_call"), F.lit("("), F.lit(1)), r"\.", -1)
    owner_sym = F.when(F.size(segs) > 1, F.concat_ws(".", F.element_at(segs, 1), F.element_at(segs, 2)))
    cls = catalog.where(F.col("kind") == "class").select(F.col("symbol").alias("_os")).distinct()
    j = calls.withColumn("_owner_sym", owner_sym).join(cls, F.col("_owner_sym") == F.col("_os"), "left")
    return j.withColumn("owned", F.col("_os").isNotNull()).drop("_owner_sym", "_os")


def build_nodes(task_calls: DataFrame, catalog: DataFrame, *, keep_module_children: bool = False,
                simple_split: bool = False) -> DataFrame:
    """D11 without nesting: D2 -> D7 / D3 -> D8 -> B5.

    ``task_calls(task_id, api_call, ord)``.  Resolution (D1-D6) runs once per
    distinct text (calls and owner paths), then joins back.
    """
    # intermediate tables read by several later joins are checkpointed: this
    # keeps the plans small (self joins) and lets a lost executor restart
    # from the written table instead of from the corpus
    tc = cut_lineage(split_by_owner(task_calls, catalog))
    paths = cut_lineage(C.call_path(tc.select("api_call")))       # the Python stage: once per distinct text
    # Owner path = parts before the first subscript part (when the text has a '['),
    # else all but the last part; the method is the rest
    first_sub = F.array_position(F.transform("path", lambda p: F.contains(p, F.lit("["))), True)
    has_br = F.contains(F.col("api_call"), F.lit("["))
    cut = F.when(has_br & (first_sub > 0), first_sub - 1).otherwise(F.size("path") - 1)
    owned = (tc.where("owned").join(paths.select("api_call", "path"), "api_call")
               .withColumn("_cut", cut)
               .withColumn("base", F.array_join(F.slice("path", F.lit(1), F.col("_cut")), "."))
               .withColumn("method", F.array_join(F.slice("path", F.col("_cut") + 1, F.size("path")), "."))
               .withColumn("chain_text", F.when(F.contains("method", F.lit("[")),
                                                F.concat_ws(".", "base", "method")).otherwise(F.col("api_call"))))
    # owners and subscripted methods are texts of their own; few of them, and no call's path is worked out again
    more = owned.select(F.col("base").alias("api_call")).unionByName(owned.select(F.col("chain_text").alias("api_call")))
    more = more.distinct().join(paths, "api_call", "left_anti")
    info = C.resolve_texts(paths.unionByName(cut_lineage(C.call_path(more))), catalog, simple_split=simple_split)
    info = cut_lineage(info.select("api_call", "name", "type", "signature", "value", "resolved"))

    # owners: key = base, first appearance order; chain = method, last call wins
    owners = (owned.groupBy("task_id", "base").agg(F.min("ord").alias("ord"))
                   .join(info.withColumnRenamed("api_call", "base"), "base")
                   .select("task_id", F.col("base").alias("top"), F.lit(0).alias("grp"), "ord",
                           "name", "type", "signature", "value", "resolved"))
    chains = (owned.groupBy("task_id", "base", "method")
                   .agg(F.max_by("chain_text", "ord").alias("chain_text"), F.min("ord").alias("cord"))
                   .join(info.withColumnRenamed("api_call", "chain_text"), "chain_text")
                   .select("task_id", F.col("base").alias("top"), F.array("method").alias("sub"), "cord",
                           "name", "type", "signature", "value", "resolved"))
    # standalone: key = resolved name, last call of a name wins, first appearance order
    stand = (tc.where(~F.col("owned")).join(info, "api_call")
               .groupBy("task_id", "name")
               .agg(F.max_by(F.struct("type", "signature", "value", "resolved"), "ord").alias("_i"),
                    F.min("ord").alias("ord"))
               .select("task_id", F.col("name").alias("top"), F.lit(1).alias("grp"), "ord",
                       "name", "_i.type", "_i.signature", "_i.value", "_i.resolved"))
    # A standalone node replaces an owner of the same key (and its chains), keeping its place
    tops = owners.unionByName(stand)
    pick = tops.groupBy("task_id", "top").agg(
        F.max_by(F.struct("name", "type", "signature", "value", "resolved"), "grp").alias("_i"),
        F.min(F.struct("grp", "ord")).alias("_o"),
        F.max("grp").alias("_g"))
    top_nodes = pick.select("task_id", "top", F.array().cast("array<string>").alias("sub"),
                            F.struct(F.col("_o.grp"), F.col("_o.ord")).alias("korder"),
                            F.col("_g").alias("winner"),
                            "_i.name", "_i.type", "_i.signature", "_i.value", "_i.resolved")
    live_chains = chains.join(top_nodes.where(F.col("winner") == 0).select("task_id", "top", "korder"),
                              ["task_id", "top"])
    nodes = top_nodes.drop("winner").unionByName(
        live_chains.select("task_id", "top", "sub", "korder", "name", "type", "signature", "value",
                           "resolved", F.col("cord").alias("_cord")), allowMissingColumns=True)
    nodes = nodes.withColumnRenamed("_cord", "corder")   # null for top-level nodes (sorts first)
    # Top-level modules go, with their chains
    if not keep_module_children:
        mods = top_nodes.where(F.col("type") == "module").select("task_id", "top")
        nodes = nodes.join(mods, ["task_id", "top"], "left_anti")
    else:
        # V3 option: the methods of a module owner are lifted to top-level keys of their own
        mods = top_nodes.where(F.col("type") == "module").select("task_id", "top", F.lit(True).alias("_mod"))
        j = nodes.join(mods, ["task_id", "top"], "left")
        is_mod = F.coalesce(F.col("_mod"), F.lit(False))
        lifted = j.where(is_mod & (F.size("sub") > 0)).withColumn("top", F.col("name")) \
                  .withColumn("sub", F.array().cast("array<string>")).withColumn("corder", F.lit(None).cast(j.schema["corder"].dataType))
        nodes = j.where(~is_mod).unionByName(lifted).drop("_mod")
    return cut_lineage(nodes)


def nest_nodes(nodes: DataFrame) -> DataFrame:
    """D9 + D10: move dotted top-level keys below their parent key.

    ``a.b.m`` goes below ``a.b`` if that key is present when ``a.b.m`` is
    processed (keys in order; a key already moved is gone), else below
    ``a`` in a container ``b``; ``base[i].m`` goes to ``base -> [i] -> m`` and a
    ``callable`` base becomes a ``class``.  One join finds the keys that have a
    parent or grandparent key at all; only these go through rounds, one per
    dot level that occurs among them (a parent always has fewer dots), and a round
    writes its own level only.  Adds ``path``; of several nodes at one path the
    last stays (a moved key replaces a method of that name, in its place).
    """
    keys = (nodes.where(F.size("sub") == 0)
                 .select("task_id", "top", "korder", "type",
                         (F.length("top") - F.length(F.regexp_replace("top", r"\.", ""))).alias("dots")))
    is_sub = F.contains(F.col("top"), F.lit("[")) & F.contains(F.col("top"), F.lit("]."))
    lb = F.length("top") - F.locate("[", F.reverse("top")) + 1          # position of the last '['
    sub_base = F.regexp_replace(F.substr("top", F.lit(1), lb - 1), r"\.+$", "")
    sub_tail = F.substr("top", lb + 1, F.length("top"))
    sub_idx = F.substring_index(sub_tail, "].", 1)
    sub_meth = F.substr(sub_tail, F.instr(sub_tail, "].") + 2, F.length(sub_tail))
    segs = F.split("top", r"\.", -1)
    n = F.size(segs)
    k = keys.select(
        "*", is_sub.alias("is_sub"),
        F.when(is_sub, sub_base).when(n > 1, F.array_join(F.slice(segs, F.lit(1), n - 1), ".")).alias("b1"),
        F.when(~is_sub & (n > 2), F.array_join(F.slice(segs, F.lit(1), n - 2), ".")).alias("b2"),
        F.when(is_sub, F.array(F.concat(F.lit("["), sub_idx, F.lit("]")), sub_meth))
         .when(n > 1, F.array(F.element_at(segs, -1))).alias("s1"),
        F.when(~is_sub & (n > 2), F.array(F.element_at(segs, -2), F.element_at(segs, -1))).alias("s2"))
    def key(tag):
        return k.select(F.col("task_id").alias(f"_{tag}t"), F.col("top").alias(f"_{tag}k")).distinct()

    k1, k2 = key(1), key(2)
    k = stage(k.join(k1, (F.col("task_id") == k1["_1t"]) & (F.col("b1") == k1["_1k"]), "left")
               .join(k2, (F.col("task_id") == k2["_2t"]) & (F.col("b2") == k2["_2k"]), "left")
               .select(*k.columns, (F.col("_1k").isNotNull() | F.col("_2k").isNotNull()).alias("_has")), "keys")
    placed = k.where(~F.col("_has")).select("*", F.lit(False).alias("moved"), F.array("top").alias("path"),
                                            F.lit(None).cast("string").alias("parent"))
    for level in sorted(r[0] for r in k.where("_has").select("dots").distinct().collect()):
        cur = k.where(F.col("_has") & (F.col("dots") == level))
        # parents have fewer dots, so their place is already final

        def ref(tag):
            return placed.select(F.col("task_id").alias(f"_{tag}t"), F.col("top").alias(f"_{tag}k"),
                                 F.col("korder").alias(f"_{tag}o"), F.col("moved").alias(f"_{tag}m"),
                                 F.col("path").alias(f"_{tag}p"))
        r1, r2 = ref(1), ref(2)
        j = (cur.join(r1, (cur["task_id"] == r1["_1t"]) & (cur["b1"] == r1["_1k"]), "left")
                .join(r2, (cur["task_id"] == r2["_2t"]) & (cur["b2"] == r2["_2k"]), "left"))
        # present = a key of the map that was not moved before this key's turn
        pres1 = F.col("_1k").isNotNull() & ((F.col("_1o") > F.col("korder")) | ~F.col("_1m"))
        pres2 = F.col("_2k").isNotNull() & ((F.col("_2o") > F.col("korder")) | ~F.col("_2m"))
        path = (F.when(pres1, F.concat(F.col("_1p"), F.col("s1")))
                 .when(pres2, F.concat(F.col("_2p"), F.col("s2")))
                 .otherwise(F.array("top")))
        parent = F.when(pres1, F.col("b1")).when(pres2, F.col("b2"))
        placed = placed.unionByName(stage(j.select(*k.columns, (pres1 | pres2).alias("moved"), path.alias("path"),
                                                   parent.alias("parent")), "level"))
    # A callable base that receives a subscript child becomes a class
    promoted = placed.where(F.col("is_sub") & F.col("parent").isNotNull()) \
                     .select("task_id", F.col("parent").alias("top")).distinct() \
                     .withColumn("_promote", F.lit(True))
    out = (nodes.join(placed.select("task_id", "top", F.col("path").alias("fpath")), ["task_id", "top"], "left")
                .join(promoted, ["task_id", "top"], "left")
                .withColumn("type", F.when(F.coalesce("_promote", F.lit(False)) & (F.size("sub") == 0)
                                           & (F.col("type") == "callable"), F.lit("class"))
                            .otherwise(F.col("type")))
                .withColumn("path", F.concat("fpath", "sub"))
                .drop("fpath", "_promote"))
    # where a node came into its parent's children: methods with their owner, moved keys later
    place = F.struct((F.size("sub") > 0).alias("_m"), "korder", "corder")
    turn = F.when((F.size("path") > 1) & (F.size("sub") == 0), F.struct(
        F.lit(1).alias("moved"), F.col("korder.grp").alias("grp"), F.col("korder.ord").alias("ord"))).when(
        F.size("sub") > 0, F.struct(F.lit(0).alias("moved"), F.lit(0).alias("grp"), F.col("corder").alias("ord"))).otherwise(
        F.struct(F.lit(0).alias("moved"), F.col("korder.grp").alias("grp"), F.col("korder.ord").alias("ord")))
    rest = [c for c in out.columns if c not in ("task_id", "path")]
    last = out.withColumn("_turn", turn).groupBy("task_id", "path").agg(
        F.max_by(F.struct(*rest), F.struct((F.size("sub") == 0).alias("_t"), place.alias("_p"))).alias("_n"),
        F.min("_turn").alias("turn"))
    return cut_lineage(last.select("task_id", "path", "_n.*", "turn"))


def _steps(nested: DataFrame) -> DataFrame:
    """Every place on the way down to a node: ``at``, its first ``n`` keys."""
    steps = nested.select("task_id", "path", "turn", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    return steps.withColumn("at", F.slice("path", F.lit(1), F.col("n")))


def places(nested: DataFrame) -> DataFrame:
    """``(task_id, at, place)`` of all nodes and containers among their siblings.

    A container has the place of the first node that was put right below it (what lies deeper came with that node).
    """
    more = F.size("path") - F.size("at")
    return _steps(nested).groupBy("task_id", "at").agg(F.coalesce(
        F.min(F.when(more == 0, F.col("turn"))), F.min(F.when(more == 1, F.col("turn")))).alias("place"))


def depth_first(nested: DataFrame) -> DataFrame:
    """Add ``dfs``: the places of all nodes on the way down, an order key of the rows of a task."""
    ways = (_steps(nested).select("task_id", "path", "n", "at").join(places(nested), ["task_id", "at"])
                 .groupBy("task_id", "path").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("dfs")))
    return nested.join(ways, ["task_id", "path"])


def attach_schemas(nested: DataFrame) -> DataFrame:
    """Parameter schema per node.  A top-level node gets one when it has a
    type; a nested node only when it has no children; nothing below an
    untyped top-level node.  No signature -> no schema (E6 for constants)."""
    # every proper prefix of a path has something below it, a container's too
    parents = (nested.where(F.size("path") > 1)
                     .select("task_id", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_n"))
                     .select("task_id", F.slice("path", F.lit(1), F.col("_n")).alias("path"))
                     .distinct().withColumn("_has_children", F.lit(True)))
    j = nested.join(parents, ["task_id", "path"], "left")
    root = nested.where(F.size("path") == 1).select(
        "task_id", F.element_at("path", 1).alias("_root"), F.col("resolved").alias("_root_typed"))
    j = j.withColumn("_root", F.element_at("path", 1)).join(root, ["task_id", "_root"], "left")
    has_children = F.coalesce("_has_children", F.lit(False))
    eligible = F.coalesce("_root_typed", F.lit(False)) & F.col("resolved") & \
        ((F.size("path") == 1) | ~has_children)
    # a signature is parsed once per distinct text
    sigs = nested.where("resolved").select(F.col("type").alias("_t"), F.col("signature").alias("_g")).distinct()
    sigs = sigs.withColumn("_schema", S.schema_json(F.col("_t"), F.col("_g")))
    j = j.join(sigs, F.col("type").eqNullSafe(F.col("_t")) & F.col("signature").eqNullSafe(F.col("_g")), "left")
    return j.withColumn("parameters_json", F.when(eligible, F.col("_schema"))).withColumn("has_children", has_children) \
            .drop("_has_children", "_root", "_root_typed", "_t", "_g", "_schema")


def flatten_nodes(schemas: DataFrame) -> DataFrame:
    """One row per node with data (containers give none, B6):
    ``(task_id, full_name, name, type, signature, value, parameters_json, resolved, path, dfs)``,
    in the order of ``dfs`` within a task (depth first, as the maps are walked)."""
    return schemas.select("task_id", F.array_join("path", ".").alias("full_name"), "name", "type",
                          "signature", "value", "parameters_json", "resolved", "path", "dfs") \
                  .where(F.col("name").isNotNull())


def build_api_info(task_calls: DataFrame, catalog: DataFrame, **kw) -> DataFrame:
    """D11 + E7 + E8: task call lists to schema rows."""
    return flatten_nodes(attach_schemas(depth_first(nest_nodes(build_nodes(task_calls, catalog, **kw)))))
