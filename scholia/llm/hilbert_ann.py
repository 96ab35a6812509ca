"""Approximate nearest neighbours along shifted Hilbert curves of projected vectors.

Vectors are projected on ``CURVES`` frames of ``DIMS`` axes, drawn from the covariance of the vectors, so that axes follow
their main directions; each coordinate is brought to its quantile, shifted by a random offset and put on a Hilbert curve.
Largest inner product becomes smallest distance by one more coordinate, sqrt(L**2 - |x|**2) for L the largest length,
which is 0 for queries brought to length L.

A frame says most about vectors that it shows long.  So a row is put on the ``placed`` curves on which its projection is
longest (by rank on each curve), and a query asks on as many.  Each curve is cut into ``blocks`` key ranges of about equal
size.  A query looks at its own range and ``half`` ranges on either side, on each of its curves; the ranges' best are merged
and reranked by exact products.  Neither ``placed`` nor ``half`` is a constant: of all pairs that reached ``recall`` on a bounded sample of
the rows, where the true neighbours are known by brute force, it is the one with the least work.  Neighbours on the sample are
as many as make their distance that of the whole table's.  Where no pair reaches it, all ranges of all curves are looked at.

The sample's own best rows of a query are candidates as well, and no row that is worse than the worst of them is sent on.
Queries of one range go to groups of about ``GROUP_QUERIES``, to each of which the range's rows are copied.

Equal vectors are collapsed first; each keeps its ``TOP + 1`` smallest ids, which is all that a result can hold.  So
one very common vector is one row on the curves.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold a null or non-finite
component take no part; rows that repeat an id and its vector are one; fewer candidates than ``TOP`` are all
returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 20
CURVES = 32
DIMS, BITS = 2, 16
PLACED = (4, 6, 8, 10, 12, 16, 32)
RECALL = 0.92
#: Rows that curves are fitted on (more if there are many ranges), that recall is measured on, and queries of that.
SAMPLE, MEASURED, QUERIES = 6000, 6000, 1000
#: Ranges of a curve: at least so many, and more once a range would hold more than RANGE_ROWS rows.
BLOCKS, RANGE_ROWS = 40, 50_000
GROUP_QUERIES = 20_000


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of n x d cells of ``bits`` bits (d * bits < 64), by transposing axes bit by bit."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Fitted on a sample of vectors: axes, quantiles, offsets, range bounds and the window."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, blocks: int | None = None, recall: float = RECALL, top: int = TOP, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.longest, self.sample = longest, sample
        full = self.lifted(sample)
        d = full.shape[1]
        dims = min(DIMS, d)
        self.mean = full.mean(axis=0)
        values, vectors = np.linalg.eigh((full - self.mean).T @ (full - self.mean) / len(full))
        root = vectors * np.sqrt(np.maximum(values, 1e-12))
        self.axes = np.stack([np.linalg.qr(root @ rng.normal(size=(d, dims)))[0] for _ in range(CURVES)])
        y = self.projected(full)
        self.quantiles = np.sort(y, axis=1)
        self.strengths = np.sort(np.linalg.norm(y, axis=2), axis=1)
        self.offsets = rng.random((CURVES, dims))
        keys = self.keys(y)
        order = np.argsort(-self.strength(y), axis=1)
        measured = [self._window(order, keys, placed, max(blocks or 0, BLOCKS, -(-rows * placed // CURVES // RANGE_ROWS)), rows, recall, top) for placed in PLACED]
        _, self.placed, self.blocks, self.half = min(measured)
        self.bounds = self._bounds(order, keys, self.placed, self.blocks)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))])

    def lifted_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q * (self.longest / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))])

    def projected(self, full: np.ndarray) -> np.ndarray:
        """curves x rows x dims."""
        return np.matmul((full - self.mean)[None], self.axes)

    def strength(self, y: np.ndarray) -> np.ndarray:
        """rows x curves: how long the projections are among those of the sample."""
        size = np.linalg.norm(y, axis=2)
        return np.column_stack([np.searchsorted(s, c) for s, c in zip(self.strengths, size, strict=True)]) + size.T / (size.max() + 1e-300)

    def keys(self, y: np.ndarray) -> np.ndarray:
        """curves x rows."""
        out = []
        for c in range(CURVES):
            at = np.column_stack([np.searchsorted(s, v) / (len(s) + 1) for s, v in zip(self.quantiles[c].T, y[c].T, strict=True)])
            out.append(hilbert(((at + self.offsets[c]) / 2 * (1 << BITS)).astype(np.int64)))
        return np.array(out)

    def _bounds(self, order: np.ndarray, keys: np.ndarray, placed: int, blocks: int) -> list[np.ndarray]:
        on = np.zeros(keys.T.shape, bool)
        np.put_along_axis(on, order[:, :placed], True, axis=1)
        return [np.quantile(k[on[:, c]] if on[:, c].any() else k, np.arange(1, blocks) / blocks, method="lower") for c, k in enumerate(keys)]

    def places(self, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The curves that rows are placed on, and their ranges there: rows x placed."""
        y = self.projected(full)
        curves, keys = np.argsort(-self.strength(y), axis=1)[:, : self.placed], self.keys(y)
        ranges = np.array([np.searchsorted(b, k, "right") for b, k in zip(self.bounds, keys, strict=True)])
        return curves, np.take_along_axis(ranges.T, curves, axis=1)

    def _window(self, order: np.ndarray, keys: np.ndarray, placed: int, blocks: int, rows: int, recall: float, top: int) -> tuple[float, int, int, int]:
        """Expected work, placed, blocks and half: the least window that holds neighbours, on some curve of both, in a share ``recall`` of cases."""
        n = min(len(self.sample), MEASURED)
        k = min(n - 1, max(1, -(-top * n // max(rows, 1))))
        all_ = (float(2 * CURVES), CURVES, blocks, blocks)
        if rows <= top + 1 or n < 2:
            return all_
        sample = self.sample[:n]
        q = np.arange(n)[:: max(1, n // QUERIES)][:QUERIES]
        s = sample[q] @ sample.T
        s[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        ranges = np.array([np.searchsorted(b, x[:n], "right") for b, x in zip(self._bounds(order, keys, placed, blocks), keys, strict=True)])
        on = np.zeros((n, CURVES), bool)
        np.put_along_axis(on, order[:n, :placed], True, axis=1)
        y = self.projected(self.lifted_queries(sample[q]))
        asked, query_keys = np.argsort(-self.strength(y), axis=1)[:, :placed], self.keys(y)
        apart = np.full(near.shape, blocks + 1)
        for c, bounds in enumerate(self._bounds(order, keys, placed, blocks)):
            own = np.searchsorted(bounds, query_keys[c], "right")
            there = (asked == c).any(axis=1)[:, None] & on[near, c]
            apart = np.where(there, np.minimum(apart, np.abs(ranges[c][near] - own[:, None])), apart)
        half = int(np.quantile(apart, recall, method="higher"))
        if half > blocks:
            return all_
        return placed * min(1.0, (2 * half + 1) / blocks) * placed / CURVES, placed, blocks, half


def best(ids: np.ndarray, own: np.ndarray, x: np.ndarray, q: np.ndarray, top: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its largest inner products but its own, ties to smaller ids; least: none below."""
    out = []
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        s[own[lo : lo + 256, None] == ids[None, :]] = -np.inf
        k = min(top, s.shape[1])
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        if least is not None:
            floor = np.maximum(floor, least[lo : lo + 256])
        for r in range(len(s)):
            at = np.flatnonzero((s[r] >= floor[r] - 1e-9 * abs(floor[r])) & (s[r] > -np.inf))
            exact = (x[at] * q[lo + r]).sum(axis=1)
            at_ = np.lexsort((ids[at], -exact))[:top]
            out.append((ids[at][at_], exact[at_]))
    return out


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    if not single:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    d, n, longest = sizes[0]["d"], sizes[0]["n"], float(np.sqrt(sizes[0]["longest"]))
    rows = rows.where(F.size("v") == d).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))

    # equal vectors: a class named by its smallest id, with the ids that can be in a result
    ordered = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.groupBy("k1", "k2", "vec_id").agg(F.first("v").alias("v")).withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= top + 1)
    classes = common.save(few.groupBy("k1", "k2").agg(F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    queries = queries.join(classes.select("k1", "k2", "cls"), ["k1", "k2"]).select("query_id", "cls")
    asked = classes.join(queries.select("cls").distinct(), "cls", "left_semi")

    m, n_queries = classes.count(), asked.count()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    size = max(SAMPLE, min(200_000, 40 * (m * max(PLACED) // CURVES // RANGE_ROWS)))
    share = min(1_000_000, int(1_200_000 * size / m) + 1)
    taken = classes.where(F.pmod(F.xxhash64("k2", F.lit(9)), F.lit(1_000_000)) < share).select("cls", "v").limit(2 * size).collect()
    taken.sort(key=lambda r: r["cls"])
    if len(taken) < 2:
        taken = classes.select("cls", "v").limit(50).collect()
    taken = taken[:size]
    curves = Curves(np.array([r["v"] for r in taken], float).reshape(-1, d), longest, m, recall=recall, top=top)
    known = np.array([r["cls"] for r in taken[:MEASURED]])
    groups = max(1, round(n_queries * curves.placed / CURVES * min(1.0, (2 * curves.half + 1) / curves.blocks) / GROUP_QUERIES))
    shared = spark.sparkContext.broadcast(curves)

    kept = np.dtype("<f4" if single else "<f8")  # vectors move in the precision they came in

    def pack(v: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in v.astype(kept)]

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            on, ranges = shared.value.places(shared.value.lifted(x))
            k = on.shape[1]
            at = np.repeat(np.arange(len(x)), k * groups)
            part = np.tile(np.arange(groups), len(x) * k)
            yield pd.DataFrame({"curve": np.repeat(on.ravel(), groups), "block": np.repeat(ranges.ravel(), groups), "part": part, "cls": pdf["cls"].to_numpy()[at], "v": pack(x[at]), "least": 0.0})

    def ask(batches):
        for pdf in batches:
            x, cls = np.stack(pdf["v"].to_numpy()).astype(float), pdf["cls"].to_numpy()
            own = best(known, cls, shared.value.sample[: len(known)], x, top)
            least = np.array([s[-1] if len(s) == top else -np.inf for _, s in own])
            on, ranges = shared.value.places(shared.value.lifted_queries(x))
            lo, hi = np.maximum(ranges - curves.half, 0).ravel(), np.minimum(ranges + curves.half, curves.blocks - 1).ravel()
            pair = np.repeat(np.arange(ranges.size), hi - lo + 1)
            block = np.arange(len(pair)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[pair]
            at = pair // ranges.shape[1]
            yield pd.DataFrame({"curve": on.ravel()[pair], "block": block, "part": cls[at] // every % groups, "cls": cls[at], "v": pack(x[at]), "least": least[at]})

    def sampled(batches):
        for pdf in batches:
            x, cls = np.stack(pdf["v"].to_numpy()).astype(float), pdf["cls"].to_numpy()
            yield hits_of(cls, best(known, cls, shared.value.sample[: len(known)], x, top))

    def hits_of(q: np.ndarray, got: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        if not got:
            return pd.DataFrame({"q": np.empty(0, np.int64), "cls": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame({"q": np.repeat(q, [len(c) for c, _ in got]), "cls": np.concatenate([c for c, _ in got]), "score": np.concatenate([s for _, s in got])})

    def window(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return hits_of(np.empty(0, np.int64), [])
        x, q = (np.frombuffer(b"".join(p["v"]), kept).astype(float).reshape(-1, d) for p in (left, right))
        return hits_of(right["cls"].to_numpy(), best(left["cls"].to_numpy(), right["cls"].to_numpy(), x, q, top, right["least"].to_numpy()))

    kind, hit = "curve int, block long, part long, cls long, v binary, least double", "q long, cls long, score double"
    ranged = classes.select("cls", "v").mapInPandas(place, kind).groupBy("curve", "block", "part")
    wanted = asked.select("cls", "v").mapInPandas(ask, kind).groupBy("curve", "block", "part")
    found = ranged.cogroup(wanted).applyInPandas(window, hit).unionByName(asked.select("cls", "v").mapInPandas(sampled, hit))
    # one row for each query and class, then each query's nearest
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    near = found.groupBy("q", "cls").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= top).drop("r")
    near = common.save(near, "near")

    # a query's own class follows by itself; every class gives its ids
    own = asked.where(F.size("ids") > 1).select(F.col("cls").alias("q"), "cls", square.alias("score"))
    pairs = near.unionByName(own)
    hits = pairs.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = common.save(hits.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1).select("q", "score", "vec_id"), "hits")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.withColumnRenamed("cls", "q").join(hits, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(final).cast("int"))
    return out.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
