"""Keys of texts against the column that normalises them, and how often a text is gone through."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import relational as R
from scholia.queries import QUERIES

ODD = [
    "", " ,.\n", "AbC 09", "naïve Größe, ¿qué? — 12 €", "已知三角形ABC的面积为６０。", "䷿一龥龦", "䀀鿿 a", "x\u0000y\u000bz", "😀 a 一", "� b", "@AZ[`az{/09:", None,
]


def test_keys_are_those_of_normalised_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    got = {r["id"]: (r["n_key"], r["key"]) for r in R.text_keys(df, "t", "id").collect()}
    want = {r["id"]: None if r["none"] else r["k"] for r in df.select("id", text.normalised(F.col("t")).alias("k"), F.isnull("t").alias("none")).collect()}
    assert got == {k: (None, None) if v is None else (len(v), hashlib.md5(v.encode()).hexdigest()) for k, v in want.items()}


@pytest.mark.parametrize("key", ["dup_summary", "dup_histogram", "dup_top20", "normalize", "lateral_norm"])
def test_a_text_is_gone_through_once(spark, tmp_path, key):
    """A filter on the key isn't pushed down to the texts, where it would make the key a second time, and null texts have no key."""
    rows = [(1, "a b"), (2, "ab"), (3, " "), (4, None), (5, "c" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[key](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("regexp_replace(coalesce(text") == 1
    got = {tuple(r) for r in df.collect()}
    a, c = hashlib.md5(b"ab").hexdigest(), hashlib.md5(b"c" * 30).hexdigest()
    want = {"dup_summary": {(2, 1, 1, 2)}, "dup_histogram": {(1, 1, 1), (2, 1, 2)}, "dup_top20": {(a, 2), (c, 1)}, "lateral_norm": {(5, 30, c)}}
    if key in want:
        assert got == want[key]
    else:
        assert {r for r in got if r[0] > 1000} == {(1001, a), (1002, a), (1003, hashlib.md5(b"").hexdigest()), (1004, None), (1005, c)}
