"""Registered queries against their SQL, and the pipeline against its rules."""

import os
from collections import Counter

import corpus_pipeline
import oracle
import pytest

from apiforge.llm import lines, mixing, packing, queries
from apiforge.session import stage

SF = "/root/testdata/sf" + os.environ.get("APIFORGE_TEST_SF", "0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    problems, n = oracle.compare(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name], con)
    assert not problems and n


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, kept = [(f.name, f.dataType) for f in docs.schema], []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = stage(step(spark, docs, SF), "test")
        if k < 4:
            assert [(f.name, f.dataType) for f in out.schema] == schema
        kept.append([r for r in out.collect()])
        docs = out
    quality, deduped, near, mixed, packed = kept
    label = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    ids = {r.doc_id for r in quality}
    known = [(i in ids) == q for i, q in label.items()]
    assert sum(known) / len(known) > 0.95
    from test_lines import plain as plain_lines
    want = {i: t for i, (n, d, t) in plain_lines([(r.doc_id, r.text) for r in quality], lines.MIN_WORDS).items() if d < n or not d}
    assert {r.doc_id: r.text for r in deduped} == want and all(r.n_chars == len(r.text) for r in deduped)
    from test_neardup import plain as plain_near
    groups = plain_near([(r.doc_id, r.text) for r in deduped], 5, 80, 100)
    assert {r.doc_id for r in near} == {i for i, (_, _, keep) in groups.items() if keep}
    sizes, taken = Counter(), Counter()
    for r in near:
        sizes[r.source] += len(r.text.encode().split())
    for r in mixed:
        taken[r.source] += len(r.text.encode().split())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    from test_tokens import check_packed
    check_packed(packed, [(r.doc_id, r.text) for r in mixed], packing.CAPACITY)
    assert mixing.MOST == 2


def test_pipeline_on_nothing(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
