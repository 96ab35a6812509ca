import os
import re

import pytest

import corpus_pipeline
from scholia.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= len(seen) and all(seen[r["doc_id"]] == r for r in rows), name
        docs, seen = spark.createDataFrame(rows, docs.schema), {r["doc_id"]: r for r in rows}
    last = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(last.doc_id) == set(seen)


def test_repeated_rows_and_missing_ids(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, t, "en", "s", 3), (1, t, "en", "s", 3), (2, t, "en", "s", 3), (None, t, "en", "s", 3), (3, None, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 3]
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.language(spark, docs, SMALL).collect()) == [0, 1, 1, 2]


def test_rows_are_judged_whatever_their_ids(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    a, b = ("one two three four five six seven eight nine ten", "an entirely different text that nobody would ever call a copy of it")
    docs = lambda rows: spark.createDataFrame([(*r, "en", "s", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, rows: sorted((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, docs(rows), SMALL).collect())
    assert left(corpus_pipeline.language, [(None, None), (None, a), (7, a), (7, None)]) == [(0, a), (7, a)]
    assert left(corpus_pipeline.near_duplicates, [(5, a), (5, b), (None, b), (None, b), (4, a + " "), (9, None), (None, None)]) == sorted([(4, a + " "), (5, b), (0, b), (9, ""), (0, "")])
    assert left(corpus_pipeline.decontamination, [(None, item), (None, a), (7, item), (7, a)]) == [(0, a), (7, a)]


CLASHES = "rejected_row scholia_row SCHOLIA_ROW_ rejected_id class_id kept n id row keep score rejected held_out item_id queue part window host path h1 x".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns_and_odd_rows(spark, name, stage):
    """Columns named like those used inside stay as they are; repeated and missing ids, long, empty and null texts don't fail."""
    some = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").collect()]
    long = "the quick brown fox and the lazy dog " * 20_000
    odd = [(1, long, "en", None, 0), (1, long, "en", None, 0), (2, None, None, "s", None), (None, "", "en", "s", 0), (None, long + "end", "en", "s", 1), some[5], (some[5][0], some[6][1], "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASHES)) for k, r in enumerate(some + odd)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        given = {r["id"]: r for r in docs.collect()}
        assert len({r["id"] for r in rows}) == len(rows) and all(given[r["id"]] == r for r in rows)
        assert len(rows) >= 0.7 * len(some)
    else:
        assert sum(r["length"] for r in rows if r["start"] == 0) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_no_documents(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, SMALL).count() == 0


def test_thirteen_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for d, _, names in os.walk(os.path.join(root, "scholia")):
        if os.path.basename(d) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    for line in open(os.path.join(d, n), encoding="utf-8"):
                        assert not re.search(r"\b(import|from)\b.*\bllm\b", line), n
