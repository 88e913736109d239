"""Every registered query must equal its DuckDB oracle on sf0.001 (and sf0.01 with
APIFORGE_TEST_SF=0.01)."""

import os

import pytest

import __spark_entry__ as E
from apiforge.plans.registry import ORACLES, QUERIES
from oracle import compare, duck

SF = os.environ.get("APIFORGE_TEST_SF", "0.001")
SF_DIR = f"/root/testdata/sf{SF}"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems, n = compare(spark, SF_DIR, name, QUERIES[name], ORACLES[name], con)
    assert not problems, problems


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert E.entry(spark).count() > 0
