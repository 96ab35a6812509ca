"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents.  In each window every queue's deficit grows by its share of the window,
and the queue hands out documents as long as the deficit covers its head document; what is left of the deficit is
carried to the next window.  ``targets`` gives sources their share of every window; the other sources share the rest
by their sizes (without targets: all do).  A queue that has run dry leaves its share to the others, in proportion.

No partition waits for another.  A queue's deficit over all windows is its credit, so its document that ends at its
token e goes to the first window whose credit covers e.  e is the document's place in its partition plus the queue's
tokens in all partitions before: a prefix sum over (partition, source) totals carries the deficits.  Window w is reached
when ``reached(v)`` tokens of all queues together have been handed out, v being the round-robin's virtual time.
Queues begin with a random part of their head document as deficit, so that many small queues don't all come due in
the same window.

A window's documents are laid end to end, queue by queue, and the windows after each other (a two-level prefix sum over
windows); the stream is cut every ``length`` tokens into sequences, and only there a document is cut.  Only the end of
the corpus leaves less than a sequence, and that rest is cut into sequences of powers of two, so nothing is padded.

Over any number of windows a queue is off its share by less than one document.  The shuffle is by window: about
``window`` tokens a group, whatever a source's size.

Defined cases: a null or empty text is one separator; null sources are one queue (of the name ''); targets of sources
that aren't there, or not above 0, are without effect; if targets add up to 1 or more, sources without one follow when
all others have run dry; repeated rows are documents of their own; very long texts are one document, whose window is
larger for it; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH = 1024
WINDOW = 64 * LENGTH
END = 0
#: Windows of one group when windows are added up: groups are added up first.
SPAN = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, json_path: str | None = None) -> DataFrame:
    """(doc_id, text, queue) to part, queue, before (the queue's tokens earlier in this partition), doc_id, n, ids."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, part, seen = tokens.encoder(json_path).ids, TaskContext.get().partitionId(), {}
        end = np.array([END], "<u2").tobytes()
        for b in common.batches(rows):
            ids, before = [], []
            for text, queue in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = ids_of(text or "") + end
                before.append(seen.get(queue, 0))
                seen[queue] = before[-1] + len(x) // 2
                ids.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int64)), b.column(2).cast(pa.string()), pa.array(before, pa.int64()), b.column(0).cast(pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["part", "queue", "before", "doc_id", "n", "ids"],
            )

    common.arrow_bytes(docs.sparkSession)
    return common.save(docs.mapInArrow(encode, "part long, queue string, before long, doc_id long, n long, ids binary"), "packing")


def round_robin(per_part: DataFrame, targets: Mapping[str, float], window: int) -> tuple[DataFrame, Column]:
    """Deficits and windows of all queues.

    per_part: queue, part, m (tokens), head (of the queue's first document there).  Gives (queue, part, carried, head,
    rate, late) and, in terms of these and of a document's ``before`` and ``n``, the window it is handed out in.
    """
    per_queue = per_part.groupBy("queue").agg(F.sum("m").alias("m"))
    wanted = {s: float(p) for s, p in targets.items() if p > 0}
    named = {r[0]: r[1] for r in per_queue.where(F.col("queue").isin([*wanted])).collect()} if wanted else {}  # no more than targets
    rest = (per_queue.where(~F.col("queue").isin([*named])).agg(F.sum("m")) if named else per_queue.agg(F.sum("m"))).first()[0] or 0
    share = {s: wanted[s] for s in named}
    left = 1 - sum(share.values())
    late = bool(rest and left <= 1e-9)  # the others come when all that have targets are through
    scale = 1 / sum(share.values()) if share and (not rest or late) else 1.0
    share = {s: p * scale for s, p in share.items()}
    left = 1.0 if late or not named else max(left, 0.0)

    whole = Window.partitionBy("queue")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("queue")] if share else F.lit(None).cast("double")
    carried = per_part.select(
        "queue", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("carried"), F.first("head").over(whole.orderBy("part")).alias("head"),
        F.coalesce(own, left * F.sum("m").over(whole) / F.lit(max(rest, 1))).alias("rate"), (own.isNull() & F.lit(late)).alias("late"),
    )

    # tokens handed out by all queues up to virtual time v, each queue's share of which is its rate
    def reached(v: Column) -> Column:
        out = F.lit(0.0)
        for s, p in share.items():
            out = out + F.least(F.lit(float(named[s])), F.lit(p) * v)
        return out if late or not rest else out + F.least(F.lit(float(rest)), F.lit(left) * v)

    phase = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    v = (F.col("carried") + F.col("before") + F.col("n") - phase * F.col("head")) / F.col("rate")
    place = F.when(F.col("late"), float(sum(named.values())) + v).otherwise(reached(v))
    return carried, F.greatest(F.ceil(place / window) - 1, F.lit(0)).cast("long")


def beginnings(sizes: DataFrame) -> DataFrame:
    """window, size to window, begin: the tokens of all windows before.  Of each group of SPAN windows one row goes to one task."""
    sizes = sizes.withColumn("span", F.floor(F.col("window") / SPAN))
    spans = sizes.groupBy("span").agg(F.sum("size").alias("size")).withColumn("one", F.lit(0))
    earlier = Window.partitionBy("one").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("span").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(spans, "span").select("window", (F.col("first") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("begin"))


def sequence_at(g: int, all_tokens: int, length: int) -> tuple[int, int, int]:
    """Sequence, offset in it and its end in the stream, for place g."""
    full = all_tokens // length
    if g < full * length:
        return g // length, g % length, (g // length + 1) * length
    k, lo, rest = full, full * length, all_tokens - full * length
    while True:
        size = 1 << (rest.bit_length() - 1)
        if g < lo + size:
            return k, g - lo, lo + size
        k, lo, rest = k + 1, lo + size, rest - size


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int = WINDOW, json_path: str | None = None,
    targets: Mapping[str, float] | None = None, with_ids: bool = False,
) -> DataFrame:
    """PIECES of all documents; with_ids: also ``window`` and the piece's ``ids`` (unsigned 16-bit, little-endian)."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    table = tokenised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), source.alias("queue")), json_path)

    per_part = common.save(table.groupBy("queue", "part").agg(F.sum("n").alias("m"), F.min(F.struct("before", "n"))["n"].alias("head")), "queues")
    all_tokens = per_part.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    carried, turn = round_robin(per_part, targets or {}, window)
    joined = table.join(common.small_or_shuffled(common.save(carried, "carried"), 200_000), ["queue", "part"])
    handed = joined.select(turn.alias("window"), "queue", (F.col("carried") + F.col("before")).alias("at"), "doc_id", "n", "ids")
    begin = common.save(beginnings(handed.groupBy("window").agg(F.sum("n").alias("size"))), "windows")
    inside = Window.partitionBy("window").orderBy("queue", "at").rowsBetween(Window.unboundedPreceding, -1)
    laid = handed.join(begin.hint("shuffle_hash"), "window").select("doc_id", "n", "ids", (F.col("begin") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("place"), "window")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows):
            out, held = [], []
            for doc_id, n, ids, place, w in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                raw, first = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                while first < n:
                    k, at, end = sequence_at(place, all_tokens, length)
                    m = min(n - first, end - place)
                    out.append((doc_id, first, m, zlib.crc32(raw[4 * first : 4 * (first + m)]), n, k, at, w))
                    held.append(ids[2 * first : 2 * (first + m)])
                    first, place = first + m, place + m
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "ids"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.binary())], names) if with_ids else pa.RecordBatch.from_arrays(columns[:7], names[:7])

    return laid.mapInArrow(cut, PIECES + (", window long, ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces with ids to one row a sequence: sequence_id, n (its tokens; less than ``length`` only at a power of two), ids, doc_ids.

    A group is one sequence, so of at most ``length`` pieces.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), ordered.alias("x")).select("sequence_id", "n", joined.alias("ids"), F.transform("x", lambda p: p["doc_id"]).alias("doc_ids"))
