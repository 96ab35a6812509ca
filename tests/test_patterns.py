"""Sets of patterns in texts, counted where the texts are read."""

import os

import oracle
from pyspark.sql import functions as F

from scholia.operators import patterns
from scholia.queries import ORACLE_SQL, QUERIES

TEXTS = [(1, "abcd efgh"), (1, "abcd"), (None, "efgh abcd"), (4, None), (5, ""), (6, "xyz")]
SETS = [("a", ["abcd", "efgh", "abcd", None, ""]), ("a", ["abcd"]), (None, ["efgh", "none"]), ("d", []), ("e", None), ("f", ["xyz"])]
WANT = sorted(map(repr, [(1, "a", 2, 2), (1, "a", 1, 1), (1, None, 2, 1), (1, "a", 2, 1), (1, "a", 1, 1), (None, "a", 2, 2), (None, "a", 1, 1), (None, None, 2, 1), (6, "f", 1, 1)]))


def held(spark, **kw):
    texts, sets = spark.createDataFrame(TEXTS, "id long, t string"), spark.createDataFrame(SETS, "name string, p array<string>")
    return sorted(repr(tuple(r)) for r in patterns.covering(texts, "id", "t", sets, "name", "p", 1, 2, **kw).collect())


def test_every_row_counts_for_itself(spark):
    assert held(spark) == WANT


def test_sets_in_parts(spark):
    assert held(spark, sent=4) == WANT


def test_no_sets_and_no_texts(spark):
    texts, sets = spark.createDataFrame(TEXTS, "id long, t string"), spark.createDataFrame(SETS, "name string, p array<string>")
    assert patterns.covering(texts, "id", "t", sets.limit(0), "name", "p", 1, 2).count() == 0
    assert patterns.covering(texts.limit(0), "id", "t", sets, "name", "p", 1, 2).count() == 0


def test_relevance_of_rows_that_share_an_id(spark, tmp_path):
    """Each row of documents and of benchmark has its own row in the result, and nothing is shuffled for it."""
    text = "the quick brown fox jumps over the lazy dog"
    spark.createDataFrame([(1, text), (1, text + " again"), (2, "nothing of it"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, text), (7, text[:30]), (8, "abc"), (9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(tmp_path, t)}.parquet/*.parquet')")
    got = QUERIES["phrase_relevance"](spark, str(tmp_path))
    assert oracle.differences(got, con, ORACLE_SQL["phrase_relevance"]) == "" and got.count() == 4
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_hits_leave_a_task_in_parts(spark, monkeypatch):
    """A batch of many texts with many hits goes out in parts, with the same rows."""
    monkeypatch.setattr(patterns, "HELD_HITS", 10)
    texts = spark.range(0, 200, 1, 1).select("id", F.lit("abcd").alias("t"))
    wanted = spark.createDataFrame([("a",), ("b",), ("bc",), ("x",)], "p string")
    assert patterns.containing(texts, "id", ["t"], wanted, "p").groupBy("p").count().orderBy("p").collect() == [("a", 200), ("b", 200), ("bc", 200)]
