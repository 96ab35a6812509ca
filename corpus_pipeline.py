"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as Parquet to the
folder that all executors share and reads them again as the next stage's documents.  A stage decides about all that
its predecessor kept, and all but the last return whole rows of documents with the columns they came with.

Stages decide about rows, whatever their ids: language, quality and decontamination pass the rows through and let the
rejected ones go; near_duplicates writes its input with a key of each row.  Of near copies one row stays, that of the
smallest id; of copies without an id one stays as well, even beside one with an id.
Keys to take out are sent to every task only if there are at most ``SENT_IDS``; more are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bm25_wand, common, langid, packing, probminhash, site_bayes

SENT_IDS = 2_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, fixed by writing them, and the key's name, which no column of docs has."""
    key = common.fresh(docs, "scholia_row")
    return common.save(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _without(rows: DataFrame, key: str, out: DataFrame) -> DataFrame:
    """rows (of _numbered) without those whose keys ``out`` holds in its only column."""
    out = common.save(out.toDF(key).distinct(), "rejected")
    return rows.join(common.small_or_shuffled(out, SENT_IDS), key, "left_anti").select(*(rows[c] for c in rows.columns if c != key))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null and empty texts, texts without a letter, and those no language is likely of.

    Rows that share an id, or have none, are judged each by its own text; repeated rows alike; texts of any length whole;
    an empty table stays empty; all columns are kept, whatever their names.
    """
    return langid.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low go; labels say of an id's rows what they say of the id.

    Rows that share an id, or have none, are judged each by its own text and site; a null text as an empty one; repeated
    rows alike; texts of any length whole; an empty table stays empty; all columns are kept, whatever their names.
    """
    return site_bayes.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near copies stays, and one of those without an id.

    Different texts that share an id all stay; of repeated rows one stays; rows without a word are copies of none and
    stay; texts of any length whole; an empty table stays empty; all columns are kept, whatever their names.
    """
    rows, key = _numbered(docs)
    ids = rows.select(key, F.col("doc_id").cast("long").alias("id"), F.col("doc_id").isNull().alias("unnamed"))
    group = ["class_id", "unnamed"]
    member = common.save(probminhash.classes(rows, id_col=key).select(F.col("doc_id").alias(key), "class_id").join(ids, key), "copies")
    kept = member.groupBy(*group).agg(F.min(F.struct("id", key))[key].alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = common.save(kept, "kept")
    return _without(rows, key, member.join(common.small_or_shuffled(kept, SENT_IDS), group).where(F.col(key) != F.col("kept")).select(key))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Rows that share an id, or have none, are judged each by its own text; null and empty texts stay; repeated rows go or
    stay together; texts of any length whole; without items all stay; all columns are kept, whatever their names.
    """
    return bm25_wand.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as pieces of sequences (see ``packing``); a null or empty text is one separator, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: No SQL gives these rows: they rest on learned models, hashed sketches and a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = common.save(docs, name)
    return docs
