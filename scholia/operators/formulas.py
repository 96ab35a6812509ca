"""Formulas of texts: only rows that hold a mark of a formula leave the JVM, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas


def readable(text: Column) -> Column:
    """The text with formulas as they read; null is empty, and what can't be read stays as it is."""

    @F.pandas_udf("string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(formulas.readable, na_action="ignore")

    marked = text.rlike(r"[$\\]")
    return F.coalesce(read(F.when(marked, text)), F.btrim(F.coalesce(text, F.lit("")), F.lit(formulas.BLANK)))


def pieces(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with one row for each piece of text_col: line (from 0), nth in the line (from 0), kind (text, math, display), piece.  A text of no piece has none."""

    @F.pandas_udf("array<struct<line: int, kind: string, piece: string>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [{"line": line, "kind": kind, "piece": v} for line, kind, v in formulas.pieces(t)])

    whole = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, k: F.struct(k.cast("int").alias("line"), F.lit("text").alias("kind"), x.alias("piece")))
    own = F.when(F.col(text_col).rlike(r"[$\\]"), cut(F.when(F.col(text_col).rlike(r"[$\\]"), F.col(text_col)))).otherwise(F.filter(whole, lambda p: p["piece"] != ""))
    at = F.transform(F.col("_p"), lambda p, k: p.withField("nth", (k - F.size(F.filter(F.col("_p"), lambda q: q["line"] < p["line"]))).cast("int")))
    return rows.withColumn("_p", own).withColumn("_p", F.explode(at)).select(*(rows[c] for c in rows.columns), "_p.line", "_p.nth", "_p.kind", "_p.piece")
