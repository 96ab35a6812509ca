"""Ranked lexical search: a join of items and documents seeded with thresholds.

1. One pass over the texts counts the items' terms in every document: a table of rows (n, terms, counts), which holds what
   the later passes read.  Its sums give the statistics of the score (see ``weights``).
2. For every term its ``top`` largest impacts are stored, with their rows.  So many documents score at least a term's least
   stored impact, so the largest of these among an item's terms is a lower bound of the item's last score.
3. The rows stored for terms are scored in full against all items.  The last of an item's best scores among them is its
   threshold; it is at least the bound of step 2.
4. The join.  An item's terms are in order of their largest impacts.  As long as the sum of the largest stays below the threshold,
   no document can reach it by these terms alone: they are pruned, and only documents that hold one of the others are
   candidates.  A candidate whose score by the others, with the sum of the pruned ones added, stays below the threshold
   goes; the rest are scored exactly.  A task keeps each item's best and raises its thresholds by them; what is left of all tasks
   is ranked.

Scores are 64-bit integers and every bound is one, so nothing is lost: the result is that of scoring all pairs.

Items go to all tasks in shards of at most ``SHARD`` items and about ``SHARD_TERMS`` terms (an item with more is alone); each shard
reads the texts once.  A task holds the stored impacts of a shard's terms and ``CELLS`` numbers.

Defined cases: null and empty texts, and texts without a term, count as no document and have no rank; null and empty items have no
rows; items that repeat with one id and text are ranked once, different texts of one id are items of their own; rows that
share an id are documents of their own; equal scores come by ascending id, rows without an id last; texts of any length are
counted whole; an empty table on either side gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
SHARD, SHARD_TERMS = 100_000, 1_000_000
CELLS, DOCS = 4 << 20, 1024
#: Bytes of a text that are cut into terms at once, and rows sent to all tasks at most.
STEP_BYTES, SENT_ROWS = 1 << 20, 1_000_000
SALTS = 64
#: In UTF-8, ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`` is a digit, a letter of ASCII or a byte beyond it.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LAST = np.iinfo(np.int64).max


def count_terms(text: str | None) -> Counter[bytes]:
    """How often each term is in the text, A-Z in lower case."""
    raw = (text or "").encode().lower()  # of bytes, this is A-Z only
    if len(raw) <= STEP_BYTES:
        return Counter(TERM.findall(raw))
    out, lo = Counter(), 0
    while lo < len(raw):
        hi = lo + STEP_BYTES
        while hi < len(raw) and TERM.match(raw, hi):  # a term isn't cut
            hi += 1
        out.update(TERM.findall(raw[lo:hi]))
        lo = hi
    return out


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms, among ``docs`` documents of ``terms`` terms in all."""
    return 100 - 90 + (90 * n * docs) // terms


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Items(NamedTuple):
    """A shard's items: ids, terms of each by place (places begin at ``at``), and the place of every term."""

    ids: list[int | None]
    terms: np.ndarray
    at: np.ndarray
    place: dict[bytes, int]


def shards_of(items: DataFrame) -> Iterator[Items]:
    """Distinct items with at least one term, in shards of checked size."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            terms = [sorted(count_terms(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    held = common.save(items.mapInArrow(run, "item_id long, terms array<binary>").where(F.size("terms") > 0), "items")
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    shards = max(-(-n // SHARD), -(-size // SHARD_TERMS))
    for k in range(shards):
        own = held.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(shards)) == k).collect()
        if own:
            own.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["terms"]))
            place = {t: p for p, t in enumerate(sorted({bytes(t) for r in own for t in r["terms"]}))}
            yield Items([r["item_id"] for r in own], np.array([place[bytes(t)] for r in own for t in r["terms"]], np.int64), np.cumsum([0, *(len(r["terms"]) for r in own)]), place)


COUNTED = "row long, doc_id long, n long, terms array<int>, counts array<int>"


def counted(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """Step 1: documents with at least one term, and how often each holds the terms given; written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in common.batches(rows):
            n, terms, counts, size = [], [], [], []
            for t in b.column(2):
                tf = count_terms(t.as_py())
                own = sorted((place[x], tf[x]) for x in tf.keys() & place.keys())
                n.append(tf.total())
                size.append(len(own))
                terms.extend(x for x, _ in own)
                counts.extend(x for _, x in own)
            at = pa.array(np.cumsum([0, *size]), pa.int32())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, counts))], ["row", "doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.array(n, bool)))

    return common.save(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, COUNTED), "counted")


class Weights(NamedTuple):
    """What the score takes of all documents: how many, how many terms, and the weight of each of the shard's terms."""

    docs: int
    terms: int
    weight: np.ndarray

    def postings(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of COUNTED: the term and impact of every posting, and how many each row has."""
        lists = b.column(3)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = lists.flatten().to_numpy(zero_copy_only=False), b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        m = length_norm(b.column(2).to_numpy(zero_copy_only=False), self.docs, self.terms)
        return term, impacts(self.weight[term], tf, np.repeat(m, size)), size


def weights(rows: DataFrame, terms: int) -> Weights:
    docs, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most the shard's terms
    out = np.zeros(terms, np.int64)
    out[df["term"].to_numpy()] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df["count"].tolist()]
    return Weights(docs, size, out)


def stored(rows: DataFrame, known: Weights, top: int) -> DataFrame:
    """Step 2: term, impact, row of the largest impacts of every term, at most ``top`` each."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        least = np.zeros(len(known.weight), np.int64)  # the last of the best so far, once there are enough
        kept = [np.empty(0, np.int64)] * 3
        for b in common.batches(batches):
            term, impact, size = known.postings(b)
            some = impact > least[term]
            term, impact, row = (np.concatenate([a, c[some]]) for a, c in zip(kept, (term, impact, np.repeat(b.column(0).to_numpy(), size)), strict=True))
            by = np.lexsort((row, -impact, term))
            first = np.flatnonzero(np.diff(term[by], prepend=-1))
            nth = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
            by = by[nth < top]
            kept = [term[by], impact[by], row[by]]
            full = nth[nth < top] == top - 1
            least[kept[0][full]] = kept[1][full]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), *map(pa.array, kept[1:])], ["term", "impact", "row"])

    out = rows.mapInArrow(run, "term int, impact long, row long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["term", "salt"], ["term"]):
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("impact"), "row"))).where(F.col("nth") <= top)
    return common.save(out.select("term", "impact", "row"), "impacts")


class Join:
    """A shard's items with their thresholds: which terms are pruned, and who holds the others."""

    def __init__(self, items: Items, known: Weights, most: np.ndarray, threshold: np.ndarray, top: int):
        """most: each term's largest impact; threshold: a lower bound of each item's last score, 0 for none."""
        self.known, self.top, self.threshold = known, top, threshold
        self.pruned, self.others, self.rest = [], [], []
        pairs = []
        for k in range(len(items.ids)):
            own = items.terms[items.at[k] : items.at[k + 1]]
            own = own[np.argsort(most[own], kind="stable")]
            total = np.cumsum(most[own])
            cut = int(np.searchsorted(total, max(1, threshold[k]), "left"))  # sums before here are below the threshold
            self.pruned.append(own[:cut])
            self.others.append(own[cut:])
            self.rest.append(int(total[cut - 1]) if cut else 0)
            pairs.append(own[cut:])
        who = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        flat = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
        by = np.argsort(flat, kind="stable")
        self.holder, self.at = who[by], np.searchsorted(flat[by], np.arange(len(known.weight) + 1))

    def scan(self, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's best rows among these: item (its number), doc_id, score."""
        own = _Best(self.top, self.threshold)
        for b in common.batches(rows, DOCS):
            term, impact, size = self.known.postings(b)
            unnamed = b.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
            self._block(own, ids, unnamed, term, impact, size)
        item, ids, unnamed, score = own.all()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=unnamed), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    def _block(self, own: _Best, ids: np.ndarray, unnamed: np.ndarray, term: np.ndarray, impact: np.ndarray, size: np.ndarray) -> None:
        if not len(term):
            return
        here, line = np.unique(term, return_inverse=True)
        if len(here) * len(size) > CELLS and len(size) > 1:
            half = len(size) // 2
            cut = int(size[:half].sum())
            self._block(own, ids[:half], unnamed[:half], term[:cut], impact[:cut], size[:half])
            self._block(own, ids[half:], unnamed[half:], term[cut:], impact[cut:], size[half:])
            return
        table = np.zeros((len(here) + 1, len(size)), np.int64)  # terms by documents; the last line is of terms that aren't here
        table[line, np.repeat(np.arange(len(size)), size)] = impact
        place = np.full(len(self.known.weight), len(here))
        place[here] = np.arange(len(here))
        held = [self.holder[self.at[t] : self.at[t + 1]] for t in here.tolist()]
        for k in np.unique(np.concatenate(held)).tolist():
            score = table[place[self.others[k]]].sum(axis=0)
            least = max(1, own.least[k])
            some = np.flatnonzero((score > 0) & (score + self.rest[k] >= least))
            if not len(some):
                continue
            score = score[some]
            lines = place[self.pruned[k]]
            lines = lines[lines < len(here)]
            if len(lines):
                score = score + table[np.ix_(lines, some)].sum(axis=0)
            good = score >= least
            if good.any():
                own.put(k, ids[some[good]], unnamed[some[good]], score[good])


class _Best:
    """The best of each item, and the least score that matters."""

    def __init__(self, top: int, threshold: np.ndarray):
        self.top, self.least, self.kept = top, threshold.copy(), {}

    def put(self, k: int, ids: np.ndarray, unnamed: np.ndarray, score: np.ndarray) -> None:
        if k in self.kept:
            ids, unnamed, score = (np.concatenate(x) for x in zip(self.kept[k], (ids, unnamed, score), strict=True))
        by = np.lexsort((ids, unnamed, -score))[: self.top]
        self.kept[k] = ids[by], unnamed[by], score[by]
        if len(by) == self.top:
            self.least[k] = max(self.least[k], score[by[-1]])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        return np.repeat(list(self.kept), [len(x[0]) for x in self.kept.values()]), *(np.concatenate(x) for x in zip(*self.kept.values(), strict=True))


def _ranked(rows: DataFrame, join: Join) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(join)
    found = rows.mapInArrow(lambda batches: shared.value.scan(batches), "item long, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= join.top)


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents of every item (item_id, text): item_id, rank from 1, doc_id, score."""
    spark = docs.sparkSession
    common.arrow_bytes(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for own in shards_of(items):
        rows = counted(docs, own.place)
        known = weights(rows, len(own.place))
        if not known.docs:
            break
        best = stored(rows, known, top)
        most, least = np.zeros((2, len(own.place)), np.int64)
        each = best.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count("*").alias("n")).toPandas()
        most[each["term"]] = each["most"]
        full = each[each["n"] == top]
        least[full["term"]] = full["least"]
        seed = np.array([least[own.terms[a:b]].max() for a, b in zip(own.at[:-1], own.at[1:], strict=True)], np.int64)
        seeds = rows.join(common.small_or_shuffled(best.select("row").distinct(), SENT_ROWS), "row", "left_semi").select(*rows.columns)
        first = _ranked(seeds, Join(own, known, most, seed, top)).where(F.col("rank") == top).select("item", "score").collect()  # at most one of each item
        for r in first:
            seed[r["item"]] = max(seed[r["item"]], r["score"])
        ids = spark.createDataFrame(list(enumerate(own.ids)), "item long, item_id long")
        found = _ranked(rows, Join(own, known, most, seed, top))
        out = out.unionByName(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS u FROM documents),
g AS (SELECT count(*) FILTER (len(u) > 0) AS docs, sum(len(u))::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(u) AS n, unnest(u) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
