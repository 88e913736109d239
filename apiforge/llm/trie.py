"""Operator 11: prefix trie of conversations by range minima over sorted longest common prefixes.

1. A conversation becomes one row: a digest of 16 bytes and a word count per turn.  Rows are sorted by
   their digests (then by id) and numbered; ``lcp[i]`` is how many turns row i shares with the row before.
2. A depth d prefix of row i holds the rows around i whose boundaries have ``lcp >= d``.  Every candidate
   prefix finds its two ends alone, by binary search on a sparse table of range minima: to the right
   for its members, to the left for where its parent begins.  No stack, no order among candidates.
3. Rows are dealt to blocks of consecutive numbers.  Searches that reach a block's border go on in a sparse
   table over the blocks' minima (at most ``MOST_BLOCKS`` rows whatever the table's size, broadcast), and end
   in the block found there.  Only prefixes that cross a border do so: at most one per depth and border.
4. All figures are range sums, minima or counts over an interval's boundaries: members r - l + 1; leaves 1 +
   the boundaries where a sequence ends that the next one does not extend; words saved, the words of
   each boundary's common prefix less those above the node; children, the boundaries of exactly its depth.

A first turn, or a whole conversation, that a third of all rows share costs no more than any other: its
rows lie in many blocks.  A conversation's digests (24 bytes a turn) must fit a task, and a block holds
``LEAST_BLOCK`` conversations (more beyond 2^29 of them).  The ids of conversations that are equal
throughout pass, a thousand to a row, through one streaming hash, as SHA-256 asks for.

Defined cases: turns sort by number, nulls first, ties by digest; a null role or text is empty; rows
without id do not take part; a conversation without turns is a member of the root only; equal
conversations share all nodes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import assign_id_num
from ..session import ship_package, stage

LEAST_BLOCK, MOST_BLOCKS, IDS_A_ROW = 512, 1 << 20, 1000
WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256(b"").hexdigest()
#: What a block says: its nodes, prefixes open to the right, prefixes it shares with the block before, ids that go
#: on from there, and itself.
ROWS = ("kind string, block long, depth long, n long, lo long, c long, g long, kids long, w long, "
        "side string, parent long, sha string, ids string, part long")


def sequences(turns: DataFrame, *, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seq``: per conversation its turns in order, as digests (hex) and numbers of words."""
    who, what = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    each = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)).alias("h"),
                 F.regexp_count(what, F.lit(WORD)).cast("long").alias("w")).alias("x"))
    return each.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")),
                                                   lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("seq"))


def rebuilt(seqs: DataFrame, family: int = 20, opening: int = 4) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``family`` instead of its own,
    h = crc32 of its decimal id % ``opening``."""
    base, h = F.col("conv_id") - F.col("conv_id") % family, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % opening).cast("int")
    first = F.max(F.when(F.col("conv_id") == base, F.slice("seq", 1, opening - 1))).over(Window.partitionBy(base))
    rows = seqs.withColumn("_h", h).withColumn("_first", F.coalesce(first, F.slice("seq", 1, 0)))
    own = F.slice("seq", F.col("_h") + 1, F.greatest(F.size("seq") - F.col("_h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice("_first", F.lit(1), F.col("_h")), own).alias("seq"))


class Ranges:
    """Sparse table of range minima of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << (len(self.levels) - 1)) <= len(values):
            last, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-k], last[k:]))
        self.n = len(values)

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last position with all values behind ``at`` up to it ``>= depth``."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            low = self.levels[k]
            further = (at + (1 << k) < self.n) & (low[np.minimum(at + 1, len(low) - 1)] >= depth)
            at[further] += 1 << k
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first position with all values behind it up to ``at`` ``>= depth``."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            low, to = self.levels[k], at - (1 << k)
            further = (to >= 0) & (low[np.clip(to + 1, 0, len(low) - 1)] >= depth)
            at[further] -= 1 << k
        return at

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of [a, b]."""
        out, size = np.zeros(len(a), self.levels[0].dtype), np.frexp(np.maximum(b - a + 1, 1))[1] - 1
        for k in np.unique(size):
            at = size == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << int(k)) + 1])
        return out


class Counted:
    """How often (or with which sum) a value stands in a range of positions."""

    def __init__(self, values: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray | None = None):
        keys = values * (n + 1) + at
        order = np.argsort(keys, kind="stable")
        self.keys, self.n = keys[order], n
        self.sums = np.concatenate([[0], np.cumsum(np.ones(len(keys), np.int64) if weights is None else weights[order])])

    def between(self, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of positions [a, b]."""
        return (self.sums[np.searchsorted(self.keys, value * (self.n + 1) + b, "right")]
                - self.sums[np.searchsorted(self.keys, value * (self.n + 1) + a, "left")])


def _upto(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def _common(a: bytes, b: bytes) -> int:
    """Turns that two rows of digests share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    return next(k for k in range(0, n, 16) if a[k:k + 16] != b[k:k + 16]) // 16


def _rows(kind: str, block: int, depth, **columns) -> pa.Table:
    n, at = len(depth), {"kind": pa.array([kind] * len(depth), pa.string()), "block": pa.array(np.full(len(depth), block), pa.int64()),
                         "depth": pa.array(np.asarray(depth, np.int64), pa.int64())}
    for field in ROWS.split(", ")[3:]:
        name, of = field.split()
        of = pa.int64() if of == "long" else pa.string()
        at[name] = pa.array(columns[name], of) if name in columns else pa.nulls(n, of)
    return pa.table(at)


def block_rows(block: int, table: pa.Table, size: int, total: int) -> pa.Table:
    """What the conversations of one block say (``ROWS``); the row before the block comes along."""
    table = table.sort_by("pos")
    pos, ids, keys = table["pos"].to_numpy(), table["conv_id"].to_numpy(), table["key"].to_pylist()
    words = table["words"].to_pylist()
    has_before = int(pos[0]) < block * size
    last_block = (block + 1) * size >= total
    lcp = np.array([-1 if not has_before else 0] + [_common(a, b) for a, b in zip(keys, keys[1:])], np.int64)
    length = np.fromiter((len(k) // 16 for k in keys), np.int64, len(keys))
    before = length[0]
    if has_before:
        pos, ids, keys, words, lcp, length = pos[1:], ids[1:], keys[1:], words[1:], lcp[1:], length[1:]
    m = len(pos)
    shorter = np.concatenate([[before], length[:-1]])
    flat = _upto(np.fromiter((w for ws in words for w in ws), np.int64))
    start = _upto(length)[:-1]

    def words_upto(i, d):
        return flat[start[i] + d] - flat[start[i]]

    shared = words_upto(np.arange(m), np.maximum(lcp, 0))                # words of the prefix shared with the row before
    ended = ((lcp < shorter) & (lcp >= 0)).astype(np.int64)              # the row before ends in a leaf
    again = (lcp == length) & (lcp == shorter) & (lcp >= 0)              # equal throughout to the row before
    sum_c, sum_g = _upto(shared), _upto(ended)
    low, least_id = Ranges(lcp), Ranges(ids)
    opens_child = np.flatnonzero((length > lcp) & (lcp >= 0))
    kids = Counted(lcp[opens_child], opens_child, m)
    cut = np.append(np.flatnonzero(~again), m)
    run_end = cut[np.searchsorted(cut[:-1], np.arange(m), "right")]      # behind the last row equal to this one

    # candidates: every depth that row i does not share with the row before
    new = length - lcp
    i = np.repeat(np.arange(m), new)
    d = np.arange(len(i)) - np.repeat(_upto(new)[:-1], new) + lcp[i] + 1
    r = low.right(i, d)
    is_open = (r == m - 1) & (not last_block)
    n, w = r - i + 1, words_upto(i, np.maximum(d - 1, 0))
    c, g = sum_c[r + 1] - sum_c[i + 1], sum_g[r + 1] - sum_g[i + 1]
    children = kids.between(d, i + 1, r) + (length[i] > d)
    lo = least_id.least(i, r)
    # parents: one depth less; from the same row on, or an interval of its own search
    pd = d - 1
    same = pd > lcp[i]
    parent, side = np.zeros(len(i), np.int64), np.array([""] * len(i), object)
    if len(i):
        parent[1:] = lo[:-1]
        side[1:] = np.where(is_open[:-1], "R", "")
    at = np.flatnonzero(~same & (d > 0))
    a, b = low.left(i[at], pd[at]), low.right(i[at], pd[at])
    parent[at] = least_id.least(a, b)
    from_left = (a == 0) & (lcp[0] >= pd[at])
    side[at] = np.where(from_left, "L", np.where((b == m - 1) & (not last_block), "R", ""))
    parent_null = (d == 0) | (side != "")
    sha, text = [_EMPTY] * len(i), [None] * len(i)
    more = []
    for k in np.flatnonzero(length[i] == d):
        own = [str(x) for x in ids[i[k]:run_end[i[k]]].tolist()]
        if is_open[k]:
            sha[k], text[k] = None, ",".join(own[:IDS_A_ROW])
            more += [(int(d[k]), ",".join(own[x:x + IDS_A_ROW]), x // IDS_A_ROW) for x in range(IDS_A_ROW, len(own), IDS_A_ROW)]
        else:
            sha[k] = hashlib.sha256(",".join(own).encode()).hexdigest()
    out = []
    common = dict(n=n, lo=lo, kids=children, w=w, side=side, sha=np.array(sha, object), ids=np.array(text, object),
                  c=c, g=g)
    for kind, these in (("node", ~is_open), ("open", is_open)):
        cols = {x: y[these] for x, y in common.items()}
        if kind == "node":
            cols["c"], cols["g"] = cols["c"] - (cols["n"] - 1) * cols["w"], cols["g"] + 1
        out.append(_rows(kind, block, d[these], parent=pa.array(parent[these], pa.int64(), mask=parent_null[these]), **cols))
    out.append(_rows("ids", block, [x[0] for x in more], side=["R"] * len(more), ids=[x[1] for x in more], part=[x[2] for x in more]))
    if has_before:
        # prefixes shared with the block before: those that end here, with their sums
        x = np.arange(lcp[0] + 1)
        y = low.right(np.zeros(len(x), np.int64), x)
        here = (y < m - 1) | last_block
        zero = np.zeros(len(x), np.int64)
        stats = dict(n=y + 1, lo=least_id.least(zero, y), c=sum_c[y + 1], g=sum_g[y + 1], kids=kids.between(x, zero, y))
        out.append(_rows("border", block, x, **{k: pa.array(v, pa.int64(), mask=~here) for k, v in stats.items()}))
        if again[0]:
            own = [str(v) for v in ids[:run_end[0]].tolist()]
            parts = [",".join(own[k:k + IDS_A_ROW]) for k in range(0, len(own), IDS_A_ROW)]
            out.append(_rows("ids", block, [length[0]] * len(parts), side=["L"] * len(parts), ids=parts, part=list(range(len(parts)))))
    out.append(_rows("block", block, [lcp.min()], n=[m], lo=[ids.min()], c=[sum_c[-1]], g=[sum_g[-1]],
                     kids=[int(((lcp == lcp.min()) & (length > lcp) & (lcp >= 0)).sum())]))
    return pa.concat_tables(out)


class Blocks:
    """The blocks as an array: range searches and sums over whole blocks."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("block")
        col = {k: table[k].to_numpy() for k in ("depth", "n", "lo", "c", "g", "kids")}
        self.low, self.least_id, self.n_blocks = Ranges(col["depth"]), Ranges(col["lo"]), len(col["n"])
        self.sums = {k: _upto(col[k]) for k in ("n", "c", "g")}
        self.kids = Counted(col["depth"], np.arange(self.n_blocks), self.n_blocks, col["kids"])

    def onward(self, block: np.ndarray, depth: np.ndarray) -> dict:
        """Where prefixes open behind ``block`` end, and sums over the blocks they fill."""
        r = self.low.right(block, depth)
        some = r > block
        lo = np.full(len(r), np.iinfo(np.int64).max)
        lo[some] = self.least_id.least(block[some] + 1, r[some])
        return {"to": r + 1, "lo2": lo, "kids2": self.kids.between(depth, block + 1, r),
                **{k + "2": v[r + 1] - v[block + 1] for k, v in self.sums.items()}}

    def origin(self, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The block where a prefix that crosses the border before ``block`` begins."""
        return self.low.left(block - 1, depth)


def prefix_nodes(seqs: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """The nodes of ``seqs(conv_id, seq)``, one conversation per id: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = seqs.sparkSession
    ship_package(spark)
    keyed = seqs.select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda x: x["h"]), "")).alias("key"),
                        F.transform("seq", lambda x: x["w"]).alias("words"))
    rows = stage(assign_id_num(stage(keyed, "conversations"), ["key", "conv_id"], name="pos"), "sorted")
    total = rows.count()
    size = max(least_block, -(-total // MOST_BLOCKS))
    block = F.floor(F.col("pos") / size).cast("long")
    last = (F.col("pos") % size == size - 1) & (F.col("pos") < total - 1)
    dealt = rows.withColumn("block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))

    def build(key, table):
        return block_rows(key[0].as_py(), table, size, total)

    said = stage(dealt.groupBy("block").applyInArrow(build, ROWS), "blocks", partition_by="kind")
    of = {k: said.filter(F.col("kind") == k) for k in ("node", "open", "border", "ids")}
    blocks = spark.sparkContext.broadcast(said.filter(F.col("kind") == "block").toArrow())     # MOST_BLOCKS rows at most

    def searched(df, schema, find):
        def run(batches):
            index = None
            for b in batches:
                index = index or Blocks(blocks.value)
                found = find(index, b.column(0).to_numpy(), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in found.values())],
                                                 names=["block", "depth", *found])
        return df.select("block", "depth").distinct().mapInArrow(run, "block long, depth long, " + schema)

    ends = searched(of["open"], "to long, lo2 long, kids2 long, n2 long, c2 long, g2 long", Blocks.onward)
    stop = of["border"].select(F.col("block").alias("to"), "depth", *(F.col(c).alias(c + "3") for c in ("n", "lo", "c", "g", "kids")))
    open_ = (of["open"].join(ends, ["block", "depth"]).join(stop, ["to", "depth"], "left"))

    def whole(c):
        return F.col(c) + F.col(c + "2") + F.coalesce(c + "3", F.lit(0))

    crossing = open_.select("block", "depth", "side", "parent", "sha", "ids", whole("n").alias("n"), F.least("lo", "lo2", "lo3").alias("lo"),
                            (whole("c") - (whole("n") - 1) * F.col("w")).alias("c"), (whole("g") + 1).alias("g"), whole("kids").alias("kids"))
    crossing = stage(crossing, "crossing")
    origins = stage(searched(of["border"], "origin long", lambda x, b, d: {"origin": x.origin(b, d)}), "origins")
    # ids of crossing prefixes, in order: from their first block, then from those they fill
    later = of["ids"].join(origins, ["block", "depth"], "left").select(
        F.when(F.col("side") == "L", F.col("origin")).otherwise(F.col("block")).alias("first"), "depth", "block", "part", "ids")
    held = crossing.filter(F.col("ids").isNotNull()).select(F.col("block").alias("first"), "depth", "block", F.lit(0).cast("long").alias("part"), "ids")
    hashed = _hashed(later.unionByName(held))
    crossing = (crossing.join(hashed.withColumnRenamed("first", "block"), ["block", "depth"], "left")
                        .withColumn("sha", F.coalesce("_sha", "sha")))
    known = (crossing.select("block", "depth", F.lit("R").alias("side"), F.col("lo").alias("_of")).union(
        origins.join(crossing.select(F.col("block").alias("origin"), "depth", "lo"), ["origin", "depth"])
               .select("block", "depth", F.lit("L"), "lo")))
    columns = ["block", "depth", "side", "parent", "n", "lo", "c", "g", "kids", "sha"]
    nodes = of["node"].select(*columns).unionByName(crossing.select(*columns))
    known = known.select("block", (F.col("depth") + 1).alias("depth"), "side", "_of")
    settled, asking = nodes.filter(F.col("side") == ""), nodes.filter(F.col("side") != "").join(known, ["block", "depth", "side"], "left")
    out = settled.unionByName(asking.withColumn("parent", F.col("_of")).select(*columns))
    return out.select(F.col("lo").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), F.col("g").alias("n_leaves"), F.col("c").alias("saved_tokens"),
                      F.col("sha").alias("ends_sha256"))


def _hashed(rows: DataFrame) -> DataFrame:
    """``first, depth, _sha`` of lists of ids that come in parts; a list streams through its task."""
    def stream(batches):
        held, h = None, None
        for b in batches:
            done = []
            for first, depth, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (first, depth) != held:
                    if held:
                        done.append((*held, h.hexdigest()))
                    held, h = (first, depth), hashlib.sha256()
                    h.update(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _digests(done)
        yield _digests([(*held, h.hexdigest())] if held else [])

    return (rows.repartition("first", "depth").sortWithinPartitions("first", "depth", "block", "part")
                .select("first", "depth", "ids").mapInArrow(stream, "first long, depth long, _sha string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=["first", "depth", "_sha"])


def prefix_trie(turns: DataFrame, *, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Nodes of the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    return prefix_nodes(rebuilt(sequences(turns)), least_block)
