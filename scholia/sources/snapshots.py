"""Line snapshots of several tables, their manifest and restore order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line ``{"t": table, "r": row}`` for each row; nulls are written."""
    rows = [df.select(F.to_json(F.struct(F.lit(name).alias("t"), F.struct("*").alias("r")), {"ignoreNullFields": "false"}).alias("line")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free digest of each table."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).cast("string").alias("digest")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, [r.select("table_name", "rows", "digest") for r in rows])


def write(tables: dict[str, DataFrame], path: str) -> None:
    lines(tables).write.text(f"{path}/rows")
    manifest(tables).write.json(f"{path}/manifest")


def restored(rows: DataFrame, name: str, schema: str | StructType) -> DataFrame:
    """One table from lines (the first column)."""
    fields = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    return rows.select(F.from_json(rows[0], f"t string, r {fields}").alias("x")).where(F.col("x.t") == name).select("x.r.*")


def restore(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One table of a snapshot."""
    return restored(spark.read.text(f"{path}/rows"), name, schema)


def levels(edges: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """Tables by the longest chain of (child, parent) references below them; a cycle is an error."""
    parents: dict[str, set[str]] = {}
    for child, parent in edges:
        parents.setdefault(child, set()).add(parent)
        parents.setdefault(parent, set())
    level: dict[str, int] = {}
    while len(level) < len(parents):
        ready = [n for n, p in parents.items() if n not in level and p <= level.keys()]
        if not ready:
            raise ValueError(f"references form a cycle: {sorted(parents.keys() - level.keys())}")
        level |= {n: 1 + max((level[p] for p in parents[n]), default=-1) for n in ready}
    return sorted(level.items(), key=lambda x: (x[1], x[0]))


def catalog(spark: SparkSession, pattern: str) -> DataFrame:
    """Columns of the session's tables whose name fits a pattern."""
    names = [x.name for x in spark.catalog.listTables() if re.fullmatch(pattern, x.name)]
    rows = [(n, c.name, c.dataType) for n in sorted(names) for c in spark.catalog.listColumns(n)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
