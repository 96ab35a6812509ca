"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import pytest

import oracle
from scholia.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_same_rows(spark, con, key):
    assert oracle.differences(QUERIES[key](spark, SMALL), con, ORACLE_SQL[key]) == ""


@pytest.mark.parametrize("key", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, key):
    assert QUERIES[key](spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("key", ["recall_dual", "recall_topn", "references_topk", "simhash_dups", "range_join", "answer_cascade", "dict_match", "keyword_tags", "locate_questions"])
def test_no_product_of_tables(spark, key):
    plan = QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_basic"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
