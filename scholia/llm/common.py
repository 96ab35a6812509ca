"""What the corpus operators share: scratch tables, Arrow access to whole texts and vectorised words.

Texts are handled as UTF-8 bytes straight from Arrow's buffers.  A word is a maximal run of
``0-9 A-Z a-z`` and bytes of non-ASCII characters, lower-cased for A-Z only; that is the same set as the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over a text whose A-Z were lower-cased.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that a Python worker gets, and bytes of text that one vectorised step looks at.
ARROW_BYTES = 8 << 20
STEP_BYTES = 2 << 20
_BATCH_BYTES, _AS_IT_COMES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    If that is unset, a local session (as in tests) gets a folder of its own; a cluster is refused, since its machines
    wouldn't see each other's files.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = _own_scratch.setdefault(context.applicationId, "")
        if not there:
            there = _own_scratch[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="scholia-")
    return there.rstrip("/")


def arrow_bytes(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session does already.

    Every operator asks for the same bound, so none changes another's; rows stay as the session has them.
    """
    if spark.conf.get(_BATCH_BYTES) == _AS_IT_COMES:
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lost executors don't lose it, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/scholia-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``save`` wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """The broadcast hint only if the table has at most ``rows`` rows; otherwise the join may shuffle."""
    return F.broadcast(df) if within(df, rows) else df


# --- texts as bytes -------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more than rows); null is as empty."""
    a = column.cast(pa.large_binary())
    n = len(a)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = a.buffers()
    at = np.frombuffer(where, np.int64, n + 1, a.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            n = max(n, 1 << 16)
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_P, _P_INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; ``starts``: offsets at which a word can't go on (of texts)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    is_word = _IS_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    cut = starts[(starts > 0) & (starts < len(data))]
    cut = np.unique(cut[is_word[cut] & is_word[cut - 1]])
    if not len(cut):
        flat = np.flatnonzero(edge)
        return flat[0::2], flat[1::2]
    flat = np.flatnonzero(edge)
    return np.sort(np.concatenate([flat[0::2], cut])), np.sort(np.concatenate([flat[1::2], cut]))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts in order, and for each text the index of its first word."""
    hashes, begins = [], []
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + STEP_BYTES)
        while hi < len(data) and _IS_WORD[data[hi - 1]] and _IS_WORD[data[hi]]:  # a word isn't cut
            hi += 1
        part = data[lo:hi]
        begin, end = word_spans(part, at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo)
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[end] - total[begin]) * down[begin]))
        begins.append(begin + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), at)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that word_hashes gives to these single words."""
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)[0]


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the index of the first of each text.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    if not len(words):
        return np.empty(0, np.uint64), begin
    rolled = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        rolled = rolled * np.uint64(_P) + padded[k : k + len(words)]
    rolled = mix(rolled)
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    out = rolled[place]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        h = int(counts[d])
        for w in words[first[d] : first[d + 1]].tolist():
            h = (h * _P + w) % (1 << 64)
        out[begin[d]] = mix(np.array([h], np.uint64))[0]
    return out, begin


def batches(rows: Iterator[pa.RecordBatch], most: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Batches that aren't empty, in parts of at most so many rows."""
    return (b.slice(k, most) for b in rows for k in range(0, b.num_rows, most))
