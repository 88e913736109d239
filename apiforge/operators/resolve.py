"""Resolve scanned facts into API calls with joins, windows and as-of lookups.

* C2 aliases: the latest import of a name before the reference (as-of),
  builtin type names as a seed table.
* C3 bindings: ``x = call(...)`` binds ``x`` to the resolved call text; a
  binding whose root is a variable continues the text of that variable's
  binding.  Chains of any depth are resolved by pointer doubling: every
  round joins each unresolved binding with the binding it points to and
  doubles the resolved distance, so a chain of depth d needs log2(d) rounds;
  rounds are checkpointed (reliable checkpoint in ``spark.checkpoint.dir``).
* C4 ``self``: class -> resolved first base, as-of.
* C5 API / non-API: a call is an API when its text starts with an import
  target of its file or a builtin type name; a key with one non-API call is
  non-API as a whole.
* C6 first occurrence of each call text per key.
"""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import DEFAULT_BLOCK, asof_last

# Builtin *types* count as imported modules; builtin functions do not.
# Derived from the running interpreter by that rule.
BUILTIN_TYPES = sorted(n for n in dir(builtins) if isinstance(getattr(builtins, n), type))

KEYS = ["task_id", "lk"]


def builtin_table(spark) -> DataFrame:
    """Builtin type names, fixed size (~100 rows): safe to broadcast."""
    return spark.createDataFrame([(n,) for n in BUILTIN_TYPES], "lk string")


def _with_builtin(df: DataFrame, spark, col: str = "lk") -> DataFrame:
    bt = F.broadcast(builtin_table(spark).withColumnRenamed("lk", "_bt"))
    return df.join(bt, df[col] == bt["_bt"], "left")


# ------------------------------------------------------------------ C2 + lookups

def lookup_space(facts: DataFrame, *, block: int = DEFAULT_BLOCK, imports_only: bool = False) -> DataFrame:
    """Build rows of the as-of lookup: imports (module ``m`` / name ``n``) at their
    position and bindings (``v`` = binding id) at the end of their statement."""
    imp = facts.where(F.col("fact") == "import").select(
        "task_id", F.col("name").alias("lk"), "seq",
        F.when(F.col("kind") == "module", F.col("target")).alias("m"),
        F.when(F.col("kind") == "name", F.col("target")).alias("n"),
        F.lit(None).cast("long").alias("v"))
    bnd = facts.where(F.col("fact") == "bind").select(
        "task_id", F.col("name").alias("lk"), F.col("seq_end").alias("seq"),
        F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("n"),
        F.col("seq").alias("v"))
    return imp if imports_only else imp.unionByName(bnd)


def max_position(facts: DataFrame) -> int:
    """Largest visit position of any file (one aggregate over the facts)."""
    r = facts.agg(F.max(F.greatest("seq", F.coalesce("seq_end", "seq")))).first()[0]
    return int(r or 0)


def resolve_aliases(probe: DataFrame, facts: DataFrame, *, block: int = DEFAULT_BLOCK,
                    max_seq: int | None = None, imports_only: bool = False) -> DataFrame:
    """C2 (+ variable lookup): add ``m`` (module target, builtin types included),
    ``n`` (imported name target) and ``v`` (id of the visible binding) for the
    name in column ``lk`` as of ``seq``."""
    spark = probe.sparkSession
    r = asof_last(probe, lookup_space(facts, imports_only=imports_only), KEYS, ["m", "n", "v"],
                  block=block, max_seq=max_seq)
    r = _with_builtin(r, spark)
    return r.withColumn("m", F.coalesce(F.col("m"), F.col("_bt"))).drop("_bt")


# ------------------------------------------------------------------ C3

def _bind_start(binds: DataFrame) -> DataFrame:
    """Initial state of every binding: resolved text so far (``acc``) and the
    binding it still depends on (``ptr``)."""
    root_hit = F.coalesce(F.col("m"), F.col("n"))
    kind = F.col("kind")
    tuple_text = F.concat(F.coalesce(root_hit, F.col("root")), F.col("rest"), F.col("args"),
                          F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    acc = (F.when(kind == "tuple", tuple_text)
            .when(root_hit.isNotNull(), F.concat(root_hit, F.col("rest")))
            .when(F.col("v").isNotNull(), F.col("rest"))
            .otherwise(F.col("target")))
    ptr = F.when((kind != "tuple") & root_hit.isNull(), F.col("v"))
    is_with = kind == "with"
    acc = F.when(is_with & ptr.isNull(), F.substring_index(acc, "(", 1)).otherwise(acc)
    return binds.select("task_id", F.col("seq").alias("id"), "seq_end", F.col("name").alias("var"),
                        acc.alias("acc"), ptr.alias("ptr"), is_with.alias("is_with"))


def resolve_binding_texts(binds: DataFrame) -> DataFrame:
    """C3 core: pointer doubling over ``(task_id, id, acc, ptr, is_with)``.

    A binding absorbs the text of the binding it points to once that one no
    longer waits for a ``with`` cut (the text of ``with f() as x`` is cut at
    the first ``(`` of its *full* text).  A round is one join of the bindings that
    still point somewhere with all bindings; finished ones are set aside.  There is no
    limit on the rounds: a pointer leads to an earlier binding, so every round finishes
    at least the first open one of each chain.
    """
    done, state = None, binds
    while True:
        state = cut_lineage(state)
        settled = state.where(F.col("ptr").isNull())
        done = settled if done is None else done.unionByName(settled)
        waiting = state.where(F.col("ptr").isNotNull())
        if waiting.isEmpty():
            break
        everything = done.unionByName(waiting)
        a = everything.select("task_id", F.col("id").alias("ptr"), F.col("acc").alias("_a_acc"),
                              F.col("ptr").alias("_a_ptr"), F.col("is_with").alias("_a_with"))
        j = waiting.join(a, ["task_id", "ptr"], "left")
        ok = F.col("_a_acc").isNotNull() & ~(F.col("_a_with") & F.col("_a_ptr").isNotNull())
        acc = F.when(ok, F.concat(F.col("_a_acc"), F.col("acc"))).otherwise(F.col("acc"))
        ptr = F.when(ok, F.col("_a_ptr")).otherwise(F.col("ptr"))
        nxt = j.select("task_id", "id", "seq_end", "var", acc.alias("acc"), ptr.alias("ptr"), "is_with")
        # a with-binding whose text just became complete gets its cut now
        state = nxt.withColumn("acc", F.when(F.col("is_with") & F.col("ptr").isNull()
                                             & F.col("acc").contains("("),
                                             F.substring_index("acc", "(", 1)).otherwise(F.col("acc")))
    return done.select("task_id", "id", "seq_end", "var", F.col("acc").alias("text"))


def resolve_bindings(facts: DataFrame, *, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Every binding with its resolved text: ``(task_id, id, seq_end, var, text)``.

    The imports and bindings are written first: three steps read them, the scan runs once.
    """
    facts = cut_lineage(facts.where(F.col("fact").isin("import", "bind")).select(
        "task_id", "seq", "seq_end", "fact", "kind", "name", "target", "root", "rest", "args", "idx"))
    binds = facts.where(F.col("fact") == "bind").select(
        "task_id", "seq", "seq_end", "kind", "name", "target", "root", "rest", "args", "idx",
        F.col("root").alias("lk"))
    looked = cut_lineage(resolve_aliases(binds, facts, block=block, max_seq=max_position(facts)))
    return resolve_binding_texts(_bind_start(looked))


def variable_map(bindings: DataFrame) -> DataFrame:
    """Final variable map of each file: the last binding of each name."""
    return bindings.groupBy("task_id", "var").agg(F.max_by("text", "seq_end").alias("text"))


# ------------------------------------------------------------------ references

_PROBE_COLS = ["task_id", "seq", "seq_end", "ptype", "kind", "name", "target", "root", "rest", "args",
               "pargs", "idx", "line", "col", "cls", "lk"]


def _probes(facts: DataFrame) -> DataFrame:
    """Everything that looks a name up, in one table: bindings (their callee
    root), plain references (their root), class bases (the base name) and what hangs on
    ``self`` (the name of the class around it)."""
    f = facts.where(F.col("fact").isin("bind", "class") | ((F.col("fact") == "ref") & F.col("stored")))
    own = (F.col("fact") == "ref") & (F.col("kind") == "self")
    return f.select(*[c for c in _PROBE_COLS if c not in ("ptype", "lk")],
                    F.col("fact").alias("ptype"), F.when(own, F.col("cls")).otherwise(F.col("root")).alias("lk"))


def resolve_references(facts: DataFrame, *, block: int = DEFAULT_BLOCK,
                       keep: bool = True) -> tuple:
    """C2-C4 for a whole fact table with one as-of pass.

    Returns ``(calls, bindings)``: every stored reference that resolves to a
    call text ``(task_id, seq, api_key, api_call, line, col_offset)`` and the
    resolved bindings ``(task_id, id, seq_end, var, text)``.  The looked-up
    probe table feeds three consumers and is written once to the checkpoint
    folder (nothing stays pinned in executor memory between queries).
    """
    max_seq = max_position(facts)
    looked = resolve_aliases(_probes(facts), facts, block=block, max_seq=max_seq)
    if keep:
        looked = cut_lineage(looked)
    bindings = resolve_binding_texts(_bind_start(looked.where(F.col("ptype") == "bind")))

    refs = looked.where(F.col("ptype") == "ref")
    # C4: self.x inside a class is keyed <resolved base or class>.x (an as-of lookup among the resolved
    # classes); its call goes on like an attribute of the class's name, which may itself be imported or bound
    cls = looked.where(F.col("ptype") == "class")
    base = F.when(F.col("kind") == "attr", F.col("target")).otherwise(F.coalesce(F.col("n"), F.col("m")))
    classes = cls.select("task_id", F.col("name").alias("lk"), "seq", base.alias("c")).where(F.col("c").isNotNull())
    selfs = asof_last(refs.where(F.col("kind") == "self"), classes, KEYS, ["c"], block=block, max_seq=max_seq)
    selfs = selfs.withColumns({"name": F.concat(F.coalesce("c", "cls"), F.lit("."), "rest"), "root": F.col("cls"),
                               "kind": F.lit("attr")}).drop("c")
    refs = refs.where(F.col("kind") != "self").unionByName(selfs)
    texts = bindings.select("task_id", F.col("id").alias("v"), F.col("text").alias("vt"))
    refs = refs.join(texts, ["task_id", "v"], "left")
    inits = (facts.where(F.col("fact") == "init")
             .groupBy("task_id", F.col("name").alias("root"))
             .agg(F.min_by("target", "seq").alias("init")))
    refs = refs.join(inits, ["task_id", "root"], "left")

    # After a variable substitution the first dotted segment of the text is
    # looked up once more among modules and names (as of the reference)
    full = F.concat(F.col("vt"), F.lit("."), F.col("rest"))
    need = refs.where((F.col("kind") == "attr") & F.col("m").isNull() & F.col("n").isNull()
                      & F.col("vt").isNotNull())
    second = resolve_aliases(need.select("task_id", "seq", F.substring_index(full, ".", 1).alias("lk")),
                             facts, block=block, max_seq=max_seq, imports_only=True)
    second = second.select("task_id", "seq", F.col("m").alias("m2"), F.col("n").alias("n2"))
    refs = refs.join(second, ["task_id", "seq"], "left")

    kind, rest, m, n, vt = F.col("kind"), F.col("rest"), F.col("m"), F.col("n"), F.col("vt")
    dot_rest = F.concat(F.lit("."), rest)
    tail = F.substr(full, F.length(F.substring_index(full, ".", 1)) + 1, F.length(full))
    attr_call = (F.when(m.isNotNull(), F.concat(m, dot_rest))
                  .when(n.isNotNull(), F.concat(n, dot_rest))
                  .when(vt.isNotNull() & F.col("m2").isNotNull(), F.concat(F.col("m2"), tail))
                  .when(vt.isNotNull() & F.col("n2").isNotNull(), F.concat(F.col("n2"), tail))
                  .when(vt.isNotNull(), F.concat(vt, dot_rest))
                  .when(F.col("pargs").isNotNull() & F.col("init").isNotNull(),
                        F.concat(F.col("init"), dot_rest, F.col("pargs")))
                  .otherwise(F.col("name")))
    name_call = (F.when(m.isNotNull() & m.contains("."), m).when(n.isNotNull(), n))
    call_call = (F.when(vt.isNotNull(), F.concat(vt, dot_rest, F.col("args")))
                  .when(m.isNotNull(), F.concat(m, dot_rest, F.col("args")))
                  .when(n.isNotNull(), F.concat(n, dot_rest, F.col("args"))))
    api = F.when(kind == "attr", attr_call).when(kind == "name", name_call).otherwise(call_call)
    plain_out = refs.select("task_id", "seq", F.col("name").alias("api_key"), api.alias("api_call"),
                            "pargs", "line", "col")

    out = plain_out.where(F.col("api_call").isNotNull())
    # the callee of a call gets that call's arguments unless its text already ends with them
    with_args = F.when(F.col("pargs").isNotNull() & ~F.col("api_call").endswith(F.col("pargs")),
                       F.concat(F.col("api_call"), F.col("pargs"))).otherwise(F.col("api_call"))
    calls = out.select("task_id", "seq", "api_key", with_args.alias("api_call"), "line",
                       F.col("col").alias("col_offset"))
    return calls, bindings


# ------------------------------------------------------------------ C5, C6

def dedupe_key_calls(calls: DataFrame) -> DataFrame:
    """First occurrence (visit order) of each call text per key.
    Partial aggregation: repeated calls collapse before the shuffle."""
    first = F.min(F.struct("seq", "line", "col_offset"))
    return (calls.groupBy("task_id", "api_key", "api_call").agg(first.alias("_f"))
                 .select("task_id", "api_key", "api_call", F.col("_f.seq").alias("seq"),
                         F.col("_f.line").alias("line"), F.col("_f.col_offset").alias("col_offset")))


def import_targets(facts: DataFrame) -> DataFrame:
    """``(task_id, targets)``: what the file's import names stand for at its end.

    An alias imported again keeps its last target only (modules and imported names are
    two maps).  One row per file, as large as its list of imports.
    """
    each = F.struct("kind", "name", "seq", "target")
    last = F.filter("_i", lambda x: ~F.exists("_i", lambda y: (y["kind"] == x["kind"]) & (y["name"] == x["name"])
                                              & (y["seq"] > x["seq"])))
    return (facts.where(F.col("fact") == "import").groupBy("task_id").agg(F.collect_set(each).alias("_i"))
                 .select("task_id", F.array_distinct(F.transform(last, lambda x: x["target"])).alias("targets")))


def classify_calls(calls: DataFrame, facts: DataFrame, *, boundary: bool = False) -> DataFrame:
    """Add ``is_api`` per call and ``key_is_api`` per key.

    A call is an API when its text starts with any import target that the file has at its end
    (a call through an alias that was imported anew later is none) or a builtin type name (plain prefix test; ``boundary=True`` also demands
    a ``.``, ``(``, ``[`` or the end after the prefix).  A key with a single
    non-API call is non-API as a whole.
    """
    t = import_targets(facts)
    j = calls.join(t, "task_id", "left")
    builtins_arr = F.array(*[F.lit(b) for b in BUILTIN_TYPES])

    def hit(arr):
        if not boundary:
            return F.exists(F.coalesce(arr, F.array().cast("array<string>")),
                            lambda x: F.startswith(F.col("api_call"), x))
        return F.exists(F.coalesce(arr, F.array().cast("array<string>")),
                        lambda x: F.startswith(F.col("api_call"), x)
                        & ((F.length(F.col("api_call")) == F.length(x))
                           | F.substr(F.col("api_call"), F.length(x) + 1, F.lit(1)).isin(".", "(", "[")))
    j = j.withColumn("is_api", hit(F.col("targets")) | hit(builtins_arr)).drop("targets")
    # one key of one file has few distinct calls (C6): the window is bounded by the file
    return j.withColumn("key_is_api", F.bool_and("is_api").over(Window.partitionBy("task_id", "api_key")))


def extract_calls(facts: DataFrame, *, block: int = DEFAULT_BLOCK, boundary: bool = False,
                  keep: bool = True) -> DataFrame:
    """``(task_id, api_key, api_call, line, col_offset, seq, key_is_api)``;
    API rows are ``key_is_api``, the rest form the non-API table.

    ``keep`` writes the fact table once to the checkpoint folder; several
    lookups read it and the Python scan runs once.
    """
    if keep:
        facts = cut_lineage(facts)
    refs, _ = resolve_references(facts, block=block, keep=keep)
    first = dedupe_key_calls(refs)
    return classify_calls(first, facts, boundary=boundary).drop("is_api")
