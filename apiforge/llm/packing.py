"""Operator 9: best-fit packing by linear grouping.

Documents become token ids plus an end id; longer ones are cut into pieces of
the capacity, the first piece taking the rest.  All decisions are made on the
histogram of piece lengths, which has at most ``capacity`` entries whatever the
number of documents:

1. full pieces fill a sequence each;
2. large lengths are sorted and dealt into groups of equal cardinality; within
   a group every length is rounded up to the group's largest (linear grouping);
3. a configuration is a multiset of rounded lengths that fits; the fullest one
   that holds the longest remaining group is repeated as often as the groups allow,
   until no group is left;
4. the actual lengths are put back into their group's places, which frees what
   rounding up had reserved;
5. small lengths go, longest first, to the sequence with the least room that
   still takes them (best fit), whole runs of equal sequences at a time.

The result is a list of placements, each for a range of ranks in one length;
it is bounded by the capacity and the number of groups, and is broadcast.
Documents get their rank in their length by a distributed sort.

Defined cases: a null text is an empty one and has the end id only; repeated rows
are packed each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import assign_id_num
from ..session import ship_package, stage
from . import tokens

TOKENIZER = "byte_bpe_50k.json"
CAPACITY, GROUPS, SMALL_SHARE = 2048, 512, 8
_FIELDS = ("length", "rank", "count", "seq", "per_seq", "offset")


def configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Fullest choice of ``sizes`` (descending, ``left`` of each) with the first that is left.

    A bounded knapsack over the capacity, one vector step per copy of a size.
    """
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    last = np.full(room + 1, -2, np.int64)     # the size added last to reach a sum
    last[0] = -1
    for i in range(first, len(sizes)):
        s, n = sizes[i], left[i] - (i == first)
        for _ in range(min(n, room // s)):
            new = (last[s:] == -2) & (last[:-s] != -2) if s <= room else None
            if new is None or not new.any():
                break
            last[s:][new] = i
        if last[room] != -2:
            break
    at = int(np.flatnonzero(last != -2)[-1])
    used = {first: 1}
    while at > 0:
        i = int(last[at])
        used[i] = used.get(i, 0) + 1
        at -= sizes[i]
    return used


def plan(hist: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS,
         small_share: int = SMALL_SHARE) -> tuple[dict[str, np.ndarray], int]:
    """Placements for a histogram (``hist[s]`` pieces of length s) and the number of sequences.

    A placement puts the pieces of ``length`` with ranks ``rank`` ..
    ``rank + count - 1`` into the sequences from ``seq`` on, ``per_seq`` in each,
    from ``offset`` on.
    """
    out: list[tuple[int, ...]] = []
    seqs = 0
    if hist[capacity]:
        out.append((capacity, 0, int(hist[capacity]), 0, 1, 0))
        seqs = int(hist[capacity])
    small = capacity // small_share
    lengths = [s for s in range(capacity - 1, small, -1) if hist[s]]
    ends = np.cumsum([int(hist[s]) for s in lengths]) if lengths else np.zeros(0, np.int64)
    total = int(ends[-1]) if lengths else 0
    starts = ends - [int(hist[s]) for s in lengths] if lengths else ends

    def segments(a: int, b: int) -> list[tuple[int, int, int]]:
        """(length, rank, count) of the large pieces a .. b-1, longest first."""
        got, k = [], int(np.searchsorted(ends, a, "right"))
        while a < b:
            n = min(b, int(ends[k])) - a
            got.append((lengths[k], a - int(starts[k]), n))
            a, k = a + n, k + 1
        return got

    each = max(1, -(-total // groups))
    firsts = list(range(0, total, each))
    sizes = [lengths[int(np.searchsorted(ends, a, "right"))] for a in firsts]
    left = [min(each, total - a) for a in firsts]
    next_piece = list(firsts)
    room: dict[int, list[tuple[int, int]]] = {}     # free tokens -> runs (first sequence, count)
    while any(left):
        used = configuration(sizes, left, capacity)
        times = min(left[i] // n for i, n in used.items())
        slots = []
        for i, n in sorted(used.items()):
            for _ in range(n):
                slots.append(segments(next_piece[i], next_piece[i] + times))
                next_piece[i] += times
                left[i] -= times
        cuts = sorted({0, times} | {int(x) for s in slots for x in np.cumsum([n for _, _, n in s])})
        at = [[0, 0] for _ in slots]                  # segment, pieces of it already placed
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for s, pos in zip(slots, at):
                length, rank, n = s[pos[0]]
                out.append((length, rank + pos[1], b - a, seqs + a, 1, offset))
                offset += length
                pos[1] += b - a
                if pos[1] == n:
                    pos[0], pos[1] = pos[0] + 1, 0
            room.setdefault(capacity - offset, []).append((seqs + a, b - a))
        seqs += times
    for s in range(min(small, capacity - 1), 0, -1):
        rank, n = 0, int(hist[s])
        for free in range(s, capacity):
            while n and room.get(free):
                first, count = room[free].pop()
                per = free // s
                full = min(count, n // per)
                if full:
                    out.append((s, rank, full * per, first, per, capacity - free))
                    rank, n = rank + full * per, n - full * per
                    room.setdefault(free - per * s, []).append((first, full))
                    first, count = first + full, count - full
                if count and n:                        # n < per: one more sequence takes the rest
                    out.append((s, rank, n, first, n, capacity - free))
                    room.setdefault(free - n * s, []).append((first, 1))
                    first, count, n = first + 1, count - 1, 0
                if count:
                    room[free].append((first, count))
            if not n:
                break
        if n:
            per = capacity // s
            for count, k in ((n // per, per), (1 if n % per else 0, n % per)):
                if count:
                    out.append((s, rank, count * k, seqs, k, 0))
                    rank += count * k
                    room.setdefault(capacity - k * s, []).append((seqs, count))
                    seqs += count
    out.sort()
    cols = np.array(out, np.int64).reshape(-1, len(_FIELDS))
    return {f: cols[:, i].copy() for i, f in enumerate(_FIELDS)}, seqs


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def as_bytes(ids) -> bytes:
    """Token ids as little-endian numbers of 4 bytes."""
    return _PACKERS[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                 tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids themselves)."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        c = tokens.coder(tokenizer, "ids", as_bytes)
        for b in batches:
            take, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(tokens.totals(c, b.column(1), b"".join)):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                a, e, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    part = ids[4 * a:4 * e]
                    take.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(e - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                    a, e, k = e, e + capacity, k + 1
            cols = [b.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).mapInArrow(cut, ddl)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS,
         small_share: int = SMALL_SHARE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 .. ``capacity``.

    The input is read three times: stage it if it is costly.
    """
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():     # one row per length, capacity at most
        hist[r["length"]] = r["count"]
    placed, _ = plan(hist, capacity, groups, small_share)
    begin = np.cumsum(hist) - hist                             # number of the first piece of a length
    placed["from"] = begin[placed["length"]] + placed["rank"]
    order = np.argsort(placed["from"], kind="stable")
    table = spark.sparkContext.broadcast({k: v[order] for k, v in placed.items()})

    def place(batches):
        p = table.value
        for b in batches:
            n = b.column(b.schema.get_field_index("_n")).to_numpy()
            k = np.searchsorted(p["from"], n, "right") - 1
            i = n - p["from"][k]
            rest = [b.column(j) for j, f in enumerate(b.schema.names) if f != "_n"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(p["seq"][k] + i // p["per_seq"][k], pa.int64()),
                 pa.array(p["offset"][k] + i % p["per_seq"][k] * p["length"][k], pa.int64())],
                names=[f for f in b.schema.names if f != "_n"] + ["sequence_id", "offset"])

    numbered = assign_id_num(pieces, ["length", "doc_id", "piece"], name="_n")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return numbered.select(*pieces.columns, "_n").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS,
                   with_ids: bool = False, **how) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    rows = stage(token_pieces(docs, capacity=capacity, with_ids=with_ids, **how), "pieces")
    return pack(rows, capacity=capacity, groups=groups)
