"""Stages of the pipeline on rows that are null, empty, long, repeated, tied or oddly named."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from conftest import DOCS, prose

from apiforge.llm import neardup
from apiforge.session import stage

STAGES = dict(corpus_pipeline.STAGES)
A, B, C = (prose(random.Random(k), 80) for k in (1, 2, 3))


def table(spark, pairs, parts=3):
    """Rows of ``documents`` with further columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) + ("clash",) * (len(DOCS) - 5) for i, t in pairs], DOCS).repartition(parts)


def kept(out):
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("pairs, left", [
    ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),                                      # an id with a copy and a text of its own
    ([(1, A), (1, A), (None, B), (None, B)], [(1, A), (None, B)]),                     # repeated rows, with and without id
    ([(None, A), (7, A), (3, A), (None, C)], [(3, A), (None, C)]),                     # any id before none
    ([(1, None), (2, None), (3, ""), (4, " \n"), (None, None)], [(1, None), (2, None), (3, ""), (4, " \n"), (None, None)]),
    ([(1, A + " end"), (2, A), (2, B), (2, B + " more")], [(1, A + " end"), (2, B)]),
])
def test_near_stage(spark, pairs, left, parts):
    docs = table(spark, pairs, parts)
    out = STAGES["minhash near-dedup"](spark, docs, None)
    assert out.columns == docs.columns and all(r.key == "clash" for r in out.collect())
    got = kept(out)
    if (2, B) in left:                    # two texts of one id: either may stay
        got = [(i, B if t == B + " more" else t) for i, t in got]
    assert got == sorted(left, key=str)


def test_an_id_with_several_texts_in_any_order(spark):
    pairs = [(1, A), (1, B), (2, A + " x"), (3, B + " x"), (4, C), (None, C), (2, C)]
    want = {(1, A): 1, (1, B): 1, (2, A + " x"): 1, (3, B + " x"): 1, (4, C): 2, (None, C): None, (2, C): 2}
    for seed in range(3):
        rows = list(pairs)
        random.Random(seed).shuffle(rows)
        docs = table(spark, rows, 1 + seed)
        got = neardup.near_duplicates(docs, width=5, num=80, den=100).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, c) for (i, _), c in want.items())


@pytest.mark.parametrize("name", [n for n in STAGES if n != "minhash near-dedup"])
def test_odd_rows(spark, tmp_path, name, rows):
    """Every stage takes odd rows and passes on columns of any name."""
    docs = table(spark, [r[:2] for r in rows])
    spark.createDataFrame([(r[0], int(k % 2), 0) for k, r in enumerate(rows) if r[0] is not None] + [(None, 1, None)],
                          "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = STAGES[name](spark, docs, str(tmp_path))
    got = out.collect()
    if name == "best-fit packing":
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
        return
    assert out.columns == docs.columns and all(r.key == "clash" for r in got)
    texts, ids = {(r[0], r[1]) for r in rows}, Counter(r[0] for r in rows)
    if name != "line dedup":
        assert {(r.doc_id, r.text) for r in got} <= texts
    assert all(n <= ids[i] * (2 if name == "mixing sources" else 1) for i, n in Counter(r.doc_id for r in got).items())
    if name == "line dedup":
        assert {(r.doc_id, r.text) for r in got if r.text is None or not r.text.strip()} == {x for x in texts if x[1] is None or not x[1].strip()}


def test_near_stage_broadcasts_marked_ids_only(spark, monkeypatch):
    planned = []

    def seen(df, label="rows"):
        planned.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    monkeypatch.setattr(corpus_pipeline, "stage", seen)
    docs = table(spark, [(1, A), (5, A), (5, B)], 2)
    for most, broadcasts in ((neardup.BROADCAST_IDS, 1), (0, 0)):
        monkeypatch.setattr(neardup, "BROADCAST_IDS", most)
        out = STAGES["minhash near-dedup"](spark, docs, None)
        assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == broadcasts
        assert kept(out) == [(1, A), (5, B)]
    assert [label for label, plan in planned if "BroadcastExchange" in plan] == []
