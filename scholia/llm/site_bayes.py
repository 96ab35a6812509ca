"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A logistic regression on features of the whole text gives each document's own evidence.  Its probabilities are
summed by grouped aggregation for each host and each path of a host.  The prior of hosts is a Beta whose
concentration is estimated from the spread between hosts beyond what their sizes explain (method of moments),
and that of paths likewise around their hosts; so a site of few documents is drawn to its host, and a host of few
documents to all hosts.  A document's posterior log-odds are its own plus the shift of its path's posterior
mean against the global prior.

The classifier is fitted on a bounded sample of labelled ids (``SAMPLE``, chosen by a hash of the id), one row of each: of
rows that share an id that of the smallest hash of its text.  Statistics and scores cover all rows.

Defined cases: a null text is as an empty one, texts of any length are whole; other columns are ignored; null hosts and paths are sites of their own; without labels of
both kinds every document's own probability is the share of good labels (0.5 without labels); repeated rows
give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
KEEP = 0.5
FEATURES = ["size", "upper", "symbols", "pipes", "digits", "spaces", "stops", "other", "repeated", "distinct", "word_len", "words"]

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[[*b"!#$%&*+<=>@^~\\{}[]_"]] = 3
_KIND[[*b"|"]] = 4
_KIND[48:58] = 5
_KIND[[*b" \t\r\n\x0b\x0c"]] = 6
_KIND[[*b".,;:?"]] = 7
_KIND[128:] = 8


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """FEATURES of each text."""
    n = len(at) - 1
    size = np.diff(at)
    some = np.maximum(size, 1)
    full = np.flatnonzero(size > 0)
    counts = np.zeros((n, 9))
    if len(full):
        kinds = _KIND[data]
        for k in range(1, 9):
            counts[full, k] = np.add.reduceat((kinds == k).astype(np.int32), at[:-1][full])
    words, first = common.word_hashes(data, at)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    repeated, distinct = np.zeros(n), np.zeros(n)
    if len(words):
        same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        repeated = np.bincount(doc[1:][same], minlength=n)
        by = np.lexsort((words, doc))
        new = np.ones(len(words), bool)
        new[1:] = (words[by][1:] != words[by][:-1]) | (doc[1:] != doc[:-1])
        distinct = np.bincount(doc[new], minlength=n)
    several = np.maximum(n_words, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    return np.column_stack([
        np.log1p(size), counts[:, 1] / letters, np.sqrt(counts[:, 3] / some), np.sqrt(counts[:, 4] / some), counts[:, 5] / some, counts[:, 6] / some, counts[:, 7] / some,
        counts[:, 8] / some, repeated / several, distinct / several**0.85, (counts[:, 1] + counts[:, 2] + counts[:, 8]) / several, np.log1p(n_words),
    ])


class Classifier:
    """Logistic regression on standardised features and their squares, by iteratively reweighted least squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.weights = None
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self.wide(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            p = min(max(self.prior, 0.01), 0.99)
            return np.full(len(x), np.log(p / (1 - p)))
        return np.clip(self.wide(x) @ self.weights, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1)."""
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            x = features(*common.utf8(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "h", "x"])

    # at most about ``sample`` rows, so that the side that is sent to all is bounded
    known = docs.join(F.broadcast(labels), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h")).mapInArrow(look, "doc_id long, quality int, h long, x array<double>")
    rows = known.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Classifier(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], float))


def concentration(m: Column) -> Column:
    """Beta concentration of site means s / n around m, by the method of moments: an aggregate."""
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, F.lit(2)))
    chance = F.sum(m * (1 - m))
    var = F.greatest((spread - chance) / F.greatest(F.sum("n"), F.lit(1)), F.lit(1e-5))
    return F.coalesce(F.greatest(F.avg(m * (1 - m)) / var - 1, F.lit(2.0)), F.lit(2.0))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """scored: host, path, z.  host, path, host_posterior and path_posterior of every site, and the global mean."""
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = common.save(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mu = hosts.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5))).first()[0]
    k = hosts.agg(concentration(F.lit(mu))).first()[0]
    hosts = hosts.select("host", ((k * mu + F.col("s")) / (k + F.col("n"))).alias("host_posterior"))
    paths = paths.join(hosts, "host")
    k2 = paths.agg(concentration(F.col("host_posterior"))).first()[0]
    posterior = (k2 * F.col("host_posterior") + F.col("s")) / (k2 + F.col("n"))
    return paths.select("host", "path", "host_posterior", posterior.alias("path_posterior")), mu


def scored_rows(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, host, path, text) to doc_id, host, path, z."""

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows, 1000):
            z = model.logit(features(*common.utf8(b.column(3))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(z, pa.float64())], ["doc_id", "host", "path", "z"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(score, "doc_id long, host string, path string, z double")


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> Classifier:
    common.arrow_bytes(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels, sample)


def _site(host: Column | None, path: Column | None) -> tuple[Column, Column]:
    """By default a source is a host, and its documents of one language are a path of it; null sites are of their own."""
    return tuple(F.coalesce((F.col(name) if c is None else c).cast("string"), F.lit("")) for name, c in (("source", host), ("lang", path)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, own_score, host_posterior, path_posterior, score, keep."""
    host, path = _site(host, path)
    model = _fitted(docs, labels, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    scored = common.save(scored_rows(rows, model), "quality")
    paths, mu = posteriors(scored)
    final = 1 / (1 + F.exp(-(F.col("z") + logit(F.col("path_posterior")) - logit(F.lit(mu)))))
    out = scored.join(common.small_or_shuffled(paths, 200_000), ["host", "path"])
    return out.select("doc_id", (1 / (1 + F.exp(-F.col("z")))).alias("own_score"), "host_posterior", "path_posterior", final.alias("score"), (final >= keep).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that ``quality`` keeps, with all their columns.

    Texts are scored twice, once for their sites and once to be kept or not, so that no copy of them is written.
    """
    host, path = _site(host, path)
    model = _fitted(docs, labels, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    paths, mu = posteriors(common.save(scored_rows(rows, model).select("host", "path", "z"), "quality"))
    own = [common.fresh(docs, name) for name in ("scholia_host", "scholia_path", "scholia_shift")]
    shift = paths.select("host", "path", logit(F.col("path_posterior")) - logit(F.lit(mu))).toDF(*own)
    joined = docs.join(common.small_or_shuffled(shift, 200_000), (host == F.col(own[0])) & (path == F.col(own[1]))).select(*(docs[c] for c in docs.columns), own[2])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(batches, 1000):
            z = model.logit(features(*common.utf8(b.column(b.schema.get_field_index(text_col)).cast(pa.string()))))
            final = 1 / (1 + np.exp(-(z + b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))))
            yield b.select(range(b.num_columns - 1)).filter(pa.array(final >= keep))

    return joined.mapInArrow(look, docs.schema)
