"""Relational operators with a rule of their own; everything else is plain DataFrame code in the plans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEPT


#: Rows that a join without an equality sends to every task at once.
SENT_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on: Column, rows: int | None = None) -> DataFrame:
    """A join on a condition that has no equality: ``small`` goes to every task, in parts of about ``rows`` rows.

    The size is looked at first; a larger side is cut by hash, and ``df`` is read once for each part.
    """
    parts = max(1, -(-small.count() // (rows or SENT_ROWS)))
    cut = [small if parts == 1 else small.where(F.pmod(F.xxhash64(*small.columns), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [df.join(F.broadcast(p), on) for p in cut])


#: Bytes of UTF-8 that go from a text without Han, and those that the Han characters of ``KEPT`` begin with.
_OTHER, _HAN = bytes(b for b in range(256) if b > 127 or not chr(b).isalnum()), bytes(range(0xE4, 0xEA))
_RUNS = re.compile(KEPT + "+")


def text_keys(df: DataFrame, column: str, *carried: str) -> DataFrame:
    """carried, n_key, key: length and md5 of each text as ``text.normalised`` leaves it; null texts have null, rows stay as they are.

    A text is gone through as bytes in one call, unless a byte may begin a Han character; then by a regular expression.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for x in b.column(len(carried)):
                t = x.as_py()  # one text at a time
                if t is None:
                    sizes.append(None)
                    found.append(None)
                    continue
                if len(t.translate(None, _HAN)) < len(t):
                    kept = _RUNS.sub("", t.decode(errors="replace"))
                    n, kept = len(kept), kept.encode()
                else:
                    kept = t.translate(None, _OTHER)
                    n = len(kept)
                sizes.append(n)
                found.append(hashlib.md5(kept, usedforsecurity=False).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carried))), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], [*carried, "n_key", "key"])

    kind = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in carried) + "n_key long, key string"
    return df.select(*carried, F.col(column).cast("binary").alias("__text")).mapInArrow(keys, kind)


def any_contains(columns: list[Column], keyword: str) -> Column:
    """Case-insensitive substring search over several columns; a null column doesn't match."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(False)) for c in columns])


def since(added: Column, created: Column, start: Column) -> Column:
    """``added >= start``, where rows without ``added`` go by ``created``."""
    return F.coalesce(added, created) >= start


def sentinel_null(c: Column, sentinels: tuple[str, ...] = ("none", "null", "uncategorized")) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*sentinels) | (F.trim(c) == ""), F.lit(None)).otherwise(c)


def scope(value: int, lo: int = 1, hi: int = 12, steps: int = 2) -> list[int]:
    """The value and its neighbours, nearest first, below before above, inside lo..hi."""
    if not lo <= value <= hi:
        return []
    near = [x for s in range(1, steps + 1) for x in (value - s, value + s)]
    return [value, *(x for x in near if lo <= x <= hi)]


def in_scope(df: DataFrame, column: str, value: int) -> DataFrame:
    """Rows of the exact value if it has any, else of the values around it; null rows always come along.

    The count is one row that is joined on, so the choice is made inside the same plan.
    """
    hits = df.agg(F.count_if(F.col(column) == value).alias("__hits"))
    around = F.col(column).isin(scope(value))
    keep = F.col(column).isNull() | F.when(F.col("__hits") > 0, F.col(column) == value).otherwise(around)
    return df.join(F.broadcast(hits)).where(keep).drop("__hits")


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of at most ``most`` rows, each with its position and the exact total."""
    size, number = max(1, min(size, most)), max(1, number)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(size * (number - 1)).limit(size)
    ranked = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + size * (number - 1))
    return ranked.join(F.broadcast(total))


def keyset(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of rows of ``old`` with their key, and are added where there is none."""
    return old.join(new, key, "left_anti").unionByName(new)


def update_from(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``values`` where it has the key and a value, else as before."""
    v = values.select(key, F.col(column).alias("__new"))
    return df.join(v, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def guarded_delete(df: DataFrame, doomed: Column, most: float = 0.5) -> DataFrame:
    """Deletes rows, unless that is more than a share ``most`` of them or leaves none."""
    stats = df.agg(F.count("*").alias("__n"), F.count_if(doomed).alias("__d"))
    refused = (F.col("__d") > most * F.col("__n")) | (F.col("__d") == F.col("__n"))
    return df.join(F.broadcast(stats)).where(refused | ~F.coalesce(doomed, F.lit(False))).drop("__n", "__d")


def without_any(df: DataFrame, key: str, others: list[DataFrame]) -> DataFrame:
    """Rows whose key is in none of the other tables (each with the one column ``key``)."""
    return df.join(reduce(DataFrame.unionByName, others), key, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def mark_repeats(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """link_status: ok for the first of each key, rejected for the others; nothing is deleted."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("link_status", F.when(r == 1, "ok").otherwise("rejected"))


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """The n rows of each stratum that come first by the hash of their key, then the key."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), F.col(key))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def nearest_rank(df: DataFrame, groups: list[str], value: str, p: float) -> DataFrame:
    """The value at rank ceil(p * n) of each group (nearest-rank percentile)."""
    w = Window.partitionBy(*groups)
    ranked = df.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * p))).select(*groups, F.col(value).alias("at_rank"), "n")


def islands(df: DataFrame, groups: list[str], lo: str, hi: str, gap: Column, key: str) -> DataFrame:
    """Intervals merged while the next begins no later than the running end plus a gap."""
    before = Window.partitionBy(*groups).orderBy(lo, hi, key).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*groups).orderBy(lo, hi, key).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col(lo) > F.max(hi).over(before) + gap, F.lit(True)).cast("int")
    return df.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(upto)).groupBy(*groups, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("parts"))
