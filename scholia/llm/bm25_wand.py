"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, and overlap checks.

The index is over the test items; every passage of every training text is a query against it.  A posting's impact
is its BM25 weight over the sum of its item's weights, so an item scores 1 against a passage that holds all its
words, and one threshold ``THRESHOLD`` fits all items.  Items are in blocks, and each term knows its largest
impact in each block.

Items are in classes by length, each of an index of its own: of class S are items of more than S / 4 and at most S
words, S a power of four.  Passages are runs of ``2 * S`` words at every S words, so every occurrence of an item is
inside one passage, and what is found of an item doesn't hang on the other items' lengths.  WAND runs over all passages
of an Arrow batch at once and returns every item at or above the threshold.  A hit is verified on the text: of the
words of the item's question and of its answer (text after ``Answer:``, else its second half) the shares that lie in
runs of five words that the passage shares must both be at least ``OVERLAP``.  Where an item without that mark ends its
question isn't known, so ``WHOLE`` of all its words are enough as well, wherever they stand.

Document frequencies and the mean length are those of all items.  Items go to all tasks by broadcast, in shards of at
most ``SHARD`` items and ``SHARD_WORDS`` words; the texts are read once for each shard.

Defined cases: null or empty texts and items have no hits; items of fewer than five words must occur whole;
repeated rows give repeated hits once for each document and item; items that share an id, or have none, are items of
their own whose best hit is reported; texts of any length are whole; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
WHOLE = 0.6
WIDTH = 5
SHARD, SHARD_WORDS = 100_000, 4 << 20
BLOCK_ITEMS, MAX_BLOCKS = 16, 64
#: Cells of the table of terms by blocks, and postings, that one step looks at.
DENSE = 4 << 20
LEAST_SPAN = 16
ANSWER = re.compile(r"(?i)\banswer\s*:")


def distinct(keys: np.ndarray, cells: int = 1 << 62) -> np.ndarray:
    """Distinct keys in order; below ``cells`` all, which is marked in a table if that is small."""
    if cells <= DENSE:
        marked = np.zeros(cells, bool)
        marked[keys] = True
        return np.flatnonzero(marked)
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def places(among: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Where keys are among distinct ones in order, or -1."""
    if cells <= DENSE:
        table = np.full(cells, -1, np.int32)
        table[among] = np.arange(len(among))
        return table[keys]
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


class Statistics(NamedTuple):
    """Of all items: how many, their mean length, and in how many each term is (terms in order)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        each = np.concatenate([np.unique(w) for w in words]) if words else np.empty(0, np.uint64)
        return Statistics(len(words), float(np.mean([len(w) for w in words])) if words else 1.0, *np.unique(each, return_counts=True))


class Index:
    """The index of items of one class (of all, if no class is given)."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        """items: id, text."""
        held = []
        for item, text in items:
            words = self.words(text or "")
            if len(words):
                m = ANSWER.search(text)
                cut = len(self.words(text[: m.end()])) if m else 0
                known = 0 < cut < len(words)
                held.append((item, words, cut if known else len(words) // 2, known))
        held.sort(key=lambda h: len(h[1]))  # items of a block have like impacts, so that block maxima are tight
        all_ = Statistics.of([h[1] for h in held]) if statistics is None else statistics
        self.items = [h[0] for h in held]
        self.cuts = [h[2] for h in held]
        self.answered = [h[3] for h in held]
        n = len(held)
        self.widths = [min(WIDTH, len(h[1])) for h in held]
        self.sizes = [len(h[1]) for h in held]
        self.runs = [self.shingles(h[1], w) for h, w in zip(held, self.widths, strict=True)]
        self.vocabulary = np.unique(np.concatenate([h[1] for h in held])) if n else np.empty(0, np.uint64)
        v = len(self.vocabulary)
        rows = []
        for k, (_, words, *_) in enumerate(held):
            t, tf = np.unique(np.searchsorted(self.vocabulary, words), return_counts=True)
            rows.append((t, np.full(len(t), k), tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / all_.mean))))
        term, item, weight = (np.concatenate(c) for c in zip(*rows, strict=True)) if n else (np.empty(0, int),) * 3
        df = all_.df[np.searchsorted(all_.terms, self.vocabulary)] if n else np.empty(0)
        weight = weight * np.log(1 + (all_.n - df[term] + 0.5) / (df[term] + 0.5))
        weight = weight / np.bincount(item, weight, n)[item]
        self.size = max(BLOCK_ITEMS, -(-n // MAX_BLOCKS))
        self.blocks = max(1, -(-n // self.size))
        self.block_max = np.zeros((v, self.blocks), np.float32)
        np.maximum.at(self.block_max, (term, item // self.size), weight.astype(np.float32))
        by = np.lexsort((item, term))
        self.at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=v))])
        self.item, self.weight = item[by], weight[by]
        self.list_max = np.maximum.reduceat(self.weight, self.at[:-1]) if v else np.empty(0)

    @staticmethod
    def words(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return common.word_hashes(raw, np.array([0, len(raw)], np.int64))[0]

    @staticmethod
    def shingles(words: np.ndarray, width: int) -> np.ndarray:
        return common.shingle_hashes(words, np.array([0, len(words)]), width)[0]

    def wand(self, win: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) at or above the threshold; win, term: distinct pairs in order.

        Block-max WAND for many passages at once.  In each passage, terms by their largest impact: as long as the sum
        stays below the threshold no item can reach it by these terms, so an item must hold a term from the pivot on,
        and only the lists of those name candidates.  A candidate is bounded by the largest impacts in its block;
        those whose bound reaches the threshold are scored in full.  Candidates are pairs, never a table of all.
        """
        n, slack = len(self.items), threshold - 1e-4  # block maxima are single-precision
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        begin = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]])) if len(win) else np.empty(0, np.int64)
        ends = np.append(begin[1:], len(win))
        # passages of a step: so that their terms' block maxima and postings are bounded
        load = np.cumsum(np.maximum(self.at[term + 1] - self.at[term], self.blocks))
        k = 0
        while k < len(begin):
            lo = begin[k]
            stop = max(k + 1, int(np.searchsorted(load[ends - 1], (load[lo - 1] if lo else 0) + DENSE, "right")))
            hi = ends[stop - 1]
            first, which, k = begin[k:stop] - lo, win[begin[k:stop]], stop
            t, m = term[lo:hi], np.diff(np.append(first, hi - lo))
            row = np.repeat(np.arange(len(m)), m)
            bound = np.add.reduceat(self.block_max[t], first, axis=0) >= slack
            live = bound.any(axis=1)
            if not live.any():
                continue
            most = self.list_max[t]
            by = np.lexsort((most, row))
            total = np.cumsum(most[by])
            pivots = by[(total - np.repeat(total[first] - most[by][first], m) >= slack) & live[row[by]]]
            owner, lists = self._lists(t[pivots])
            cells = len(m) * n
            named = distinct(row[pivots][owner] * n + self.item[lists], cells)
            named = named[bound[named // n, named % n // self.size]]
            if not len(named):
                continue
            some = np.zeros(len(m), bool)
            some[named // n] = True
            own = np.flatnonzero(some[row])
            owner, lists = self._lists(t[own])
            place = places(named, row[own][owner] * n + self.item[lists], cells)
            same = place >= 0
            score = np.bincount(place[same], self.weight[lists[same]], len(named))
            hit = np.flatnonzero(score >= threshold - 1e-12)
            out.append((which[named[hit] // n], named[hit] % n, score[hit]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and which term each belongs to."""
        size = self.at[terms + 1] - self.at[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        return owner, np.arange(len(owner)) + np.repeat(self.at[terms] - np.cumsum(size) + size, size)

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the words of question, answer and (0 if the item tells them apart) both in runs that the passage shares."""
        w, n, cut = self.widths[item], self.sizes[item], self.cuts[item]
        hit = np.isin(self.runs[item], self.shingles(passage, w) if len(passage) >= w else np.empty(0, np.uint64))
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, np.flatnonzero(hit), 1)
        np.add.at(covered, np.minimum(np.flatnonzero(hit) + w, n), -1)
        inside = np.cumsum(covered[:-1]) > 0
        if cut == 0 or cut == n:
            return float(inside.mean()), float(inside.mean()), 0.0
        return float(inside[:cut].mean()), float(inside[cut:].mean()), 0.0 if self.answered[item] else float(inside.mean())


class Library:
    """Indexes of all items by class."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        words = [Index.words(text or "") for _, text in items]
        classes: dict[int, list[tuple[int, str]]] = {}
        for item, w in zip(items, words, strict=True):
            if len(w):
                classes.setdefault(max(LEAST_SPAN, 4 ** -(-(len(w) - 1).bit_length() // 2)), []).append(item)
        statistics = Statistics.of([w for w in words if len(w)]) if statistics is None else statistics
        self.indexes = [(span, Index(own, statistics)) for span, own in sorted(classes.items())]
        self.vocabulary = np.unique(np.concatenate([i.vocabulary for _, i in self.indexes])) if self.indexes else np.empty(0, np.uint64)
        self.local = []
        for _, index in self.indexes:
            local = np.full(len(self.vocabulary), -1)
            local[np.searchsorted(self.vocabulary, index.vocabulary)] = np.arange(len(index.vocabulary))
            self.local.append(local)

    def search(self, words: np.ndarray, first: np.ndarray, threshold: float, overlap: float, whole: float = WHOLE) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, id of item) to score, question and answer overlap of the best passage, for verified hits."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(self.vocabulary) or not len(words):
            return out
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[k] == words)
        n_words = np.diff(first)
        owner = np.repeat(np.arange(len(n_words)), n_words)[known]
        for (span, index), local in zip(self.indexes, self.local, strict=True):
            term = local[k[known]]
            mine = term >= 0
            at, term, doc = known[mine], term[mine], owner[mine]
            if not len(at):
                continue
            v = len(index.vocabulary)
            segs = -(-n_words // span)
            base = np.concatenate([[0], np.cumsum(segs)])
            seg = base[doc] + (at - first[doc]) // span
            # a passage is a segment and the next one of its text
            again = seg > base[doc]
            pairs = distinct(np.concatenate([seg * v + term, seg[again] * v - v + term[again]]))
            for s, item, score in zip(*(x.tolist() for x in index.wand(pairs // v, pairs % v, threshold)), strict=True):
                d = int(np.searchsorted(base, s, "right")) - 1
                a = first[d] + (s - base[d]) * span
                q, r, both = index.overlap(item, words[a : min(first[d + 1], a + 2 * span)])
                if (q >= overlap and r >= overlap) or both >= whole:
                    key = d, index.items[item]
                    out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (score, q, r))
        return out


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def shards_of(items: DataFrame) -> list[tuple[list[tuple[int, str]], Statistics | None]]:
    """Items of each shard, and the statistics of all items for its terms (None: the shard is all)."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    ordered = lambda rows: sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    shards = max(1, -(-n // SHARD), -(-size // SHARD_WORDS))
    if shards == 1:
        return [(ordered(items.collect()), None)]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            words = [Index.words(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], ["shard", "n", "terms"])

    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard")
    terms = common.save(items.select(shard, "text").mapInArrow(count, "shard int, n long, terms array<long>").where("n > 0"), "items")
    total, mean = terms.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    each = terms.select("shard", F.explode("terms").alias("term"))
    df = common.save(each.distinct().join(each.groupBy("term").agg(F.count("*").alias("df")), "term"), "frequencies")
    out = []
    for k in range(shards):
        known = df.where(F.col("shard") == k).toPandas()
        term = known["term"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(term)
        out.append((ordered(items.where(shard == k).collect()), Statistics(total, mean, term[by], known["df"].to_numpy()[by])))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and test item that it holds: HITS."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    common.arrow_bytes(docs.sparkSession)
    out = None
    for own, statistics in shards_of(items):
        shared = docs.sparkSession.sparkContext.broadcast(Library(own, statistics))

        def probe(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            library = shared.value
            for b in common.batches(rows, 1000):
                words, first = common.word_hashes(*common.utf8(b.column(1)))
                ids, best = b.column(0).to_pylist(), {}
                for (d, item), hit in library.search(words, first, threshold, overlap).items():
                    key = ids[d], item
                    best[key] = max(best.get(key, hit), hit)
                rows_ = [(*key, *hit) for key, hit in best.items()]
                columns = list(zip(*rows_, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = docs.mapInArrow(probe, HITS)
        out = hits if out is None else out.unionByName(hits)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs that hold no test item (see ``contaminated``), with all their columns; one pass through all shards, nothing is joined."""
    common.arrow_bytes(docs.sparkSession)
    out = docs
    for own, statistics in shards_of(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))):
        shared = docs.sparkSession.sparkContext.broadcast(Library(own, statistics))

        def keep(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in common.batches(rows, 1000):
                hits = shared.value.search(*common.word_hashes(*common.utf8(b.column(b.schema.get_field_index(text_col)).cast(pa.string()))), threshold, overlap)
                ok = np.ones(b.num_rows, bool)
                ok[[d for d, _ in hits]] = False
                yield b.filter(pa.array(ok))

        out = out.mapInArrow(keep, docs.schema)
    return out
