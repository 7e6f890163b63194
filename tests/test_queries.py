"""Registered queries against their SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


#: What a router learns shows on more held-out rows than the smallest tables have (40).
LEARNED = {"f05_beats_fixed"}
LARGER_DIR = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(LARGER_DIR), reason="no larger test tables")
@pytest.mark.parametrize("name", sorted(LEARNED))
def test_learned_query_equals_sql(spark, name):
    assert compare(spark, duck(LARGER_DIR), name, LARGER_DIR)[0] == "ok"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql().keys() - LEARNED))
def test_query_equals_sql(spark, con, name):
    verdict, _, rows = compare(spark, con, name, SF_DIR)
    assert verdict == "ok" and rows > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
