"""SimHash near-duplicates: banded candidates, then the greedy pass in id order by rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .graph import cut

# The 64-bit FNV-1a offset and prime; texts shorter than this are never duplicates.
OFFSET, PRIME, SHORTEST = 0xCBF29CE484222325, 0x100000001B3, 8
#: Hashes of a band from which on it is split; rounds that decide items; pairs of a block that is folded in order.
HOT, ROUNDS, MOST_PAIRS = 1000, 20, 50_000
#: Items of the first block, and how many times as large as all before it the next one is.
FIRST, GROWTH = 1000, 4


def fnv1a(units: np.ndarray) -> np.ndarray:
    """Of rows of 16-bit units."""
    h = np.full(len(units), OFFSET, np.uint64)
    for k in range(units.shape[1]):
        h = (h ^ units[:, k].astype(np.uint64)) * np.uint64(PRIME)
    return h


def simhash(s: str) -> int:
    units = np.frombuffer(s.encode("utf-16-le"), "<u2")
    if not len(units):
        return 0
    grams = np.lib.stride_tricks.sliding_window_view(units, 2) if len(units) > 1 else units[None, :]
    h = fnv1a(grams)
    ones = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    bits = 2 * ones.astype(np.int64) > len(h)
    return int((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def hashed(df: DataFrame, key: str, column: str) -> DataFrame:
    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            h = np.array([simhash(x or "") for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int64())], ["id", "h"])

    return df.select(F.col(key).cast("long").alias("id"), text.without_punctuation(F.col(column)).alias("t")).where(F.length("t") >= SHORTEST).mapInArrow(look, "id long, h long")


def _masks(distance: int) -> tuple[list[int], list[list[int]]]:
    """Bits of each band, and of each band's parts, as signed 64-bit numbers.

    At most ``distance`` of distance + 3 blocks of 64 bits differ, so three are equal: every three blocks are a band.  Of
    distance + 1 parts of a band's other bits one is equal as well.
    """
    signed = lambda bits: (m := sum(1 << k for k in bits)) - (1 << 64 if m >> 63 else 0)
    n = distance + 3
    blocks = [range(64 * k // n, 64 * (k + 1) // n) for k in range(n)]
    bands, parts = [], []
    for own in combinations(range(n), 3):
        rest = [k for i, block in enumerate(blocks) if i not in own for k in block]
        bands.append(signed(k for i in own for k in blocks[i]))
        parts.append([signed(rest[i :: distance + 1]) for i in range(distance + 1)])
    return bands, parts


def _banded(hashes: DataFrame, distance: int) -> DataFrame:
    """id, h, band, k: a row for every band."""
    masks = F.array(*map(F.lit, _masks(distance)[0]))
    return hashes.select("id", "h", F.posexplode(F.transform(masks, lambda m: F.col("h").bitwiseAND(m))).alias("band", "k"))


def near_pairs(later: DataFrame, earlier: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """id, o: pairs of different hashes (id, h) within the distance, o of the earlier ones and less than id.

    Candidates share a band of about 32 bits.  In a band with more than ``hot`` earlier hashes they share one of the
    band's parts as well.
    """
    parts = F.array(*(F.array(*map(F.lit, own)) for own in _masks(distance)[1]))
    of = _banded(earlier, distance)
    crowded = of.groupBy("band", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("band", "k", F.lit(True).alias("crowded"))

    def keyed(rows: DataFrame) -> DataFrame:
        own = F.when(F.col("crowded"), F.transform(F.get(parts, F.col("band")), lambda m, i: F.struct(i.alias("part"), F.col("h").bitwiseAND(m).alias("v"))))
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("v")))
        return rows.join(crowded, ["band", "k"], "left").select("id", "h", "band", "k", F.explode(F.coalesce(own, whole)).alias("p")).select("id", "h", "band", "k", "p.part", "p.v")

    keys = ["band", "k", "part", "v"]
    o = keyed(of).select(F.col("id").alias("o"), F.col("h").alias("g"), *keys)
    near = (F.col("o") < F.col("id")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= distance)
    return keyed(_banded(later, distance)).join(o, keys).where(near).select("id", "o").distinct()


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Items in order: one goes if an earlier neighbour stays."""
    gone: set[int] = set()
    near: dict[int, list[int]] = {}
    for i, o in zip(pdf["id"], pdf["o"], strict=True):
        near.setdefault(i, []).append(o)
    for i in sorted(near):
        if any(o not in gone for o in near[i]):
            gone.add(i)
    return pd.DataFrame({"id": sorted(gone)}, dtype="int64")


def dropped_of(pairs: DataFrame, rounds: int = ROUNDS, most: int = MOST_PAIRS) -> DataFrame:
    """The ids that go: in order of ids, an item stays if none of its earlier neighbours does.  pairs: id, o (o < id).

    As long as there are more than ``most`` pairs, all items that have no undecided earlier neighbour are decided at once, then those that they take out, and so on; among
    ids in no particular order few rounds decide all.  The rest, and what ``rounds`` of them leave (chains whose ids go up one
    by one), is folded in blocks of at most about ``most`` pairs, in order of ids; a block sees the decisions of those before it.
    """
    spark = pairs.sparkSession
    left, gone = pairs, []
    for _ in range(rounds):
        if left.limit(most + 1).count() <= most:
            break
        free = left.select(F.col("o").alias("id")).distinct().join(left.select("id").distinct(), "id", "left_anti")
        out = cut(left.join(free.withColumnRenamed("id", "o"), "o").select("id").distinct())
        if out.isEmpty():
            break
        gone.append(out)
        left = cut(left.join(out, "id", "left_anti").join(out.withColumnRenamed("id", "o"), "o", "left_anti").select("id", "o"))
    n = left.count()
    blocks = -(-n // most)
    if n:
        ends = left.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks + 1)], 100_000)).first()[0]
        decided = cut(spark.createDataFrame([], "id long"))
        low = -(1 << 63)
        for high in sorted(set(ends)):
            block = left.where((F.col("id") > low) & (F.col("id") <= high)).join(decided.withColumnRenamed("id", "o"), "o", "left_anti").select("id", "o")
            decided = cut(decided.unionByName(block.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fold, "id long")))
            low = high
        gone.append(decided)
    return reduce(DataFrame.unionByName, gone, spark.createDataFrame([], "id long"))


def duplicates(df: DataFrame, key: str, column: str, distance: int = 3) -> DataFrame:
    """id, kept_id: each duplicate with the earliest kept item within the distance.

    Equal hashes are one item.  Items are taken in blocks, in order of ids, each ``GROWTH`` times as large as all before it: most
    of a block is near what earlier blocks kept, and goes; only the rest is paired with each other (``dropped_of``).  So texts
    that are all alike cost their number times what is kept of them, not the square of it.

    Null and short texts are never duplicates; rows without an id aren't looked at; an id's rows count as copies of it; an
    empty table has no duplicates.
    """
    h = cut(hashed(df, key, column).where("id is not null"))
    first = cut(h.groupBy("h").agg(F.min("id").alias("id")))
    n, size, shares = first.count(), FIRST, []
    while size < n:
        shares.append(size / n)
        size *= GROWTH + 1
    ends = [] if not shares else first.agg(F.percentile_approx("id", shares, 100_000)).first()[0]
    kept = went = None
    for low, high in pairwise([None, *sorted(set(ends)), None]):
        block = first if low is None else first.where(F.col("id") > low)
        block = block if high is None else block.where(F.col("id") <= high)
        if kept is not None:
            out = cut(near_pairs(block, kept, distance).groupBy("id").agg(F.min("o").alias("kept_id")))
            block, went = block.join(out, "id", "left_anti"), went.unionByName(out)
        block = cut(block.select("id", "h"))
        pairs = cut(near_pairs(block, block, distance))
        gone = cut(dropped_of(pairs))
        out = pairs.join(gone, "id").join(gone.withColumnRenamed("id", "o"), "o", "left_anti").groupBy("id").agg(F.min("o").alias("kept_id"))
        own = block.join(gone, "id", "left_anti")
        went, kept = (out, own) if kept is None else (went.unionByName(out), kept.unionByName(own))
        went, kept = cut(went), cut(kept)
    of = first.join(went, "id", "left").select("h", F.coalesce("kept_id", "id").alias("kept_id"))
    return h.join(of, "h").where("id <> kept_id").select("id", "kept_id").distinct()
