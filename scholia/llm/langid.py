"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the multiset of its byte 2-, 3- and 4-grams (A-Z lower-cased, every ASCII byte that isn't a letter
read as a space), hashed into ``BUCKETS``.  Training learns an embedding for each bucket and a softmax over
the mean embedding.  Both are linear, so for prediction they fold into one table of logits for each bucket,
and a text of any length is the mean of its grams' rows.

The probabilities are calibrated by a temperature, and the rejection threshold is set so that at most
``REJECTED`` of validation rows that were right fall under it; both use a part of the training sample that SGD
doesn't see.

The sample is bounded (documented parameters): at most about ``SAMPLE`` distinct rows in equal parts by language, at least
ten each as long as that isn't more than ``MOST_ROWS`` in all, chosen by a hash of id and text from the rows that may be learned
from.  Only languages of the sample can be predicted; all of them are learned, unless there are more than ``most_langs``, which no
column of languages holds: then the most frequent ones.  Prediction runs over all rows.

Defined cases: a null text and one without a letter give ``und`` with score 0 and are rejected; null ids are
not held out, aren't learned from and keep their row; repeated rows give repeated rows; without a row to learn
from every text is ``und`` and none with a letter is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE = 2000
MOST_LANGS = MOST_ROWS = 10_000
EPOCHS = 14
REJECTED = 0.001
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint32)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def buckets(classes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    m = len(classes) - n + 1
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h = h * np.uint32(257) + classes[k : k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - 13)).astype(np.int64) % BUCKETS


def grams(data: np.ndarray, at: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """In steps: first document, where each document with grams begins, which documents those are, buckets (BUCKETS: none)."""
    for lo in range(0, len(data), step):
        hi = min(len(data), lo + step)
        d0 = int(np.searchsorted(at, lo, "right")) - 1
        d1 = int(np.searchsorted(at, hi, "left"))
        bounds = np.clip(at[d0 : d1 + 1], lo, hi) - lo
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        classes = _CLASS[data[lo : min(len(data), hi + max(GRAMS) - 1)]]
        ends = np.repeat(at[d0 + 1 : d1 + 1] - lo, np.diff(bounds))
        for n in GRAMS:
            if len(classes) < n:
                continue
            b = buckets(classes, n)[: hi - lo]
            if len(b) < hi - lo:
                b = np.concatenate([b, np.zeros(hi - lo - len(b), np.int64)])
            b[np.arange(hi - lo) + n > ends] = BUCKETS
            yield d0, bounds[:-1][full], d0 + full, b


def gram_counts(at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    return sum(np.maximum(size - n + 1, 0) for n in GRAMS)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits of each bucket, and a row of zeros
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(at) - 1, len(self.langs)))
        for _, begin, docs, b in grams(data, at, max(1 << 12, (4 << 20) // len(self.langs))):
            total[docs] += np.add.reduceat(self.table[b], begin, axis=0)
        z = (total / np.maximum(gram_counts(at), 1)[:, None] + self.bias) / self.temperature
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """x: each row's share of every bucket (half precision will do); y: index into langs."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5] if len(x) >= 50 else order[:0]
    own = order[len(held) :]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    scale = np.float32(np.sqrt(BUCKETS))  # the mean of many small embeddings, brought to the size of one
    size = 32
    for e in range(epochs):
        rate = np.float32(0.5 * (1 - e / epochs))
        for i in range(0, len(own), size):
            rows = own[np.arange(i, min(i + size, len(own)))]
            own_x = x[rows].astype(np.float32)
            mean = (own_x @ emb) * scale
            g = (softmax(mean @ w + bias) - np.eye(k, dtype=np.float32)[y[rows]]).astype(np.float32) / len(rows)
            dw, dm = mean.T @ g, (g @ w.T) * scale
            w -= rate * dw
            bias -= rate * g.sum(axis=0)
            emb -= rate * (own_x.T @ dm)
            np.clip(w, -50, 50, out=w)  # labels that no gram tells apart don't let it grow without end
            np.clip(emb, -5, 5, out=emb)
        own = rng.permutation(own)
    table = np.vstack([(emb @ w) * scale, np.zeros((1, k), np.float32)]).astype(np.float32)
    v = held if len(held) else own
    z, t = x[v].astype(np.float32) @ table[:-1] + bias, y[v]
    temperature = min(np.geomspace(0.2, 5, 33), key=lambda T: -np.log(np.maximum(softmax(z / T)[np.arange(len(v)), t], 1e-12)).sum())
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == t]
    threshold = min(0.5, float(np.quantile(right, REJECTED)) * 0.9) if len(right) else 0.0
    return Model(langs, table, bias, float(temperature), threshold)


def share(langs: int, sample: int = SAMPLE) -> int:
    """Rows of the sample for each of so many languages."""
    return max(1, min(max(10, sample // langs), max(sample, MOST_ROWS) // langs))


def fit(docs: DataFrame, sample: int = SAMPLE, most_langs: int = MOST_LANGS) -> Model | None:
    """docs: doc_id, text, lang.  Learns from rows whose crc32(doc_id) mod 4 isn't 2."""
    own = docs.where("text is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(most_langs, MOST_ROWS)).collect()}
    if not counts:
        return None
    each = share(len(counts), sample)
    below = docs.sparkSession.createDataFrame([(lang, min(1_000_000, int(1_300_000 * each / n) + 1)) for lang, n in counts.items()], "lang string, below long")
    own = own.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(below), "lang")  # at most most_langs rows
    chosen = own.where(F.pmod("h", F.lit(1_000_000)) < F.col("below")).dropDuplicates(["lang", "h"])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            data, at = common.utf8(b.column(1))
            sums = np.zeros((b.num_rows, BUCKETS + 1), np.float32)
            for _, begin, docs_, buckets_ in grams(data, at, 1 << 18):
                for d, lo, hi in zip(docs_, begin, [*begin[1:], len(buckets_)], strict=True):
                    sums[d] += np.bincount(buckets_[lo:hi], minlength=BUCKETS + 1)
            sums = sums[:, :-1] / np.maximum(gram_counts(at), 1)[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.astype("<f2").tobytes() for r in sums], pa.binary())], ["h", "lang", "x"])

    common.arrow_bytes(docs.sparkSession)
    rows = chosen.select("h", "text", "lang").mapInArrow(count, "h long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    taken: dict[str, int] = {}
    kept = []
    for r in rows:
        if taken.get(r["lang"], 0) < each:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            kept.append(r)
    langs = sorted(taken)
    y = np.array([langs.index(r["lang"]) for r in kept])
    x = np.empty((len(kept), BUCKETS), np.float16)
    for k, r in enumerate(kept):
        x[k] = np.frombuffer(r["x"], "<f2")
    del rows, kept
    return train(x, y, langs)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros(n, bool)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.logical_or.reduceat(_ASCII_LETTER[data], at[:-1][full])
    for d in full[~out[full]]:
        out[d] = any(map(str.isalpha, data[at[d] : at[d + 1]].tobytes().decode()))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most_langs: int = MOST_LANGS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(docs, sample, most_langs)

    def predict(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            data, at = common.utf8(b.column(2))
            letter = has_letter(data, at)
            if model is None:
                best, lang, rejected = np.zeros(b.num_rows), [UNKNOWN] * b.num_rows, ~letter
            else:
                p = model.scores(data, at)
                best = np.where(letter, p.max(axis=1), 0.0)
                lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letter, strict=True)]
                rejected = ~letter | (best < model.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    common.arrow_bytes(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most_langs: int = MOST_LANGS) -> DataFrame:
    """The rows of docs whose text isn't rejected (see ``identify``), with all their columns; one pass, nothing is joined."""
    model = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), sample, most_langs)

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            data, at = common.utf8(b.column(b.schema.get_field_index(text_col)).cast(pa.string()))
            ok = has_letter(data, at)
            if model is not None:
                ok &= model.scores(data, at).max(axis=1) >= model.threshold
            yield b.filter(pa.array(ok))

    common.arrow_bytes(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
