"""The queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_scan import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper import extract

    return extract(common.table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_bayes import quality

    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_automaton import scan

    return scan(common.table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(common.table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_trees import judge

    return judge(common.table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .probminhash import classes

    return classes(common.table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_ann import search

    return search(common.table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25_wand import contaminated

    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .seeded_join import rank

    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import digests

    return digests(common.table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle_fill import digests

    return digests(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_main_text, op3_quality, op4_licenses, op5_langid, op6_url_filter, op7_near_duplicates, op8_packing, op9_neighbours, op10_decontamination, op11_ranked_search, op12_bpe, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    from . import middle_fill, seeded_join

    return {"op11_ranked_search": seeded_join.ORACLE_SQL, "op13_fill_in_middle": middle_fill.ORACLE_SQL}
