"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids, each document's followed by one end-of-document id; no index says where
documents begin.  Files are looked at in blocks of a fixed number of ids that ignore document boundaries.
Each block is searched for the separator in one vectorised comparison, which gives the lengths of the
documents that begin and end inside it, the ids before its first separator and those after its last.
A prefix scan over the blocks of each file stitches documents that go over block ends: a running count of
separators numbers the documents, and the ids since the last separator are carried forward.  It has two levels,
inside spans of ``SPAN`` blocks and over a file's spans, so a file of a terabyte is no long single task.

``scan`` works on any table of blocks; ``file_blocks`` makes one from real flat files and ``write_tokens``
from documents.  ``file_blocks`` reads byte ranges: every block is a row that a task reads by its offset, so one huge
file is read by as many tasks as its blocks are dealt to, and never held whole.

Defined cases: a null or empty text is a document of no tokens (its separator only); repeated rows are
documents of their own; ids after the last separator of a file are an unfinished document and counted as
one with ``closed`` false; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Ids of a block.
BLOCK_IDS = 1 << 17
#: Blocks of a span.
SPAN = 4096
#: The separator: beyond the vocabulary, so that no text can hold it.
END_OF_DOCUMENT = 0xFFFF

BLOCKS = "file string, block long, payload binary"
WRITTEN = "file string, block long, payload binary, doc_ids array<long>"


def write_tokens(docs: DataFrame, json_path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents (doc_id, text) as token files in the shared folder: WRITTEN.

    Each task's file is a stream of ids cut into blocks.  ``doc_ids`` names the documents in the order in which
    they entered the stream, block by block as a manifest would; it says nothing of where they begin or end.
    The stream is a task's own: a lost task writes the same file again.
    """

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = tokens.encoder(json_path).ids
        file = f"part-{TaskContext.get().partitionId():07d}"
        stop = np.array([END_OF_DOCUMENT], "<u2").tobytes()
        size, held, names, block = 2 * block_ids, bytearray(), [], 0

        def out(payload: bytes) -> pa.RecordBatch:
            nonlocal names, block
            batch = pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([names], pa.list_(pa.int64()))],
                ["file", "block", "payload", "doc_ids"],
            )
            names, block = [], block + 1
            return batch

        for b in common.batches(rows):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held += ids_of(text or "") + stop
                names.append(doc_id)
                while len(held) >= size:
                    yield out(bytes(held[:size]))
                    del held[:size]
        if held or names:
            yield out(bytes(held))

    common.arrow_bytes(docs.sparkSession)
    return common.save(docs.mapInArrow(write, WRITTEN), "tokens")


def file_blocks(spark: SparkSession, path: str, item_bytes: int = 2, block_ids: int = BLOCK_IDS, tasks: int | None = None) -> DataFrame:
    """Flat files of little-endian ids as BLOCKS, read by byte ranges through Arrow's file systems (local, HDFS, object stores)."""
    step = item_bytes * block_ids
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")  # contents aren't read here
    ranges = files.select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step}L)")).alias("block"))
    ranges = ranges.repartition(tasks, "file", "block") if tasks else ranges.repartition("file", "block")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in common.batches(rows, 16):
            payload = []
            for file, length, block in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as f:
                    payload.append(f.read_at(min(step, length - block * step), block * step))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(payload, pa.binary())], ["file", "block", "payload"])

    return ranges.select("file", "length", "block").mapInArrow(read, BLOCKS)


def scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT, item_bytes: int = 2, span: int = SPAN) -> DataFrame:
    """BLOCKS to one row a document: file, ordinal (from 0), n_tokens, closed."""
    kind = {2: "<u2", 4: "<u4"}[item_bytes]

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(rows):
            out = []
            for payload in b.column(2):
                ids = np.frombuffer(payload.as_buffer(), kind)
                ends = np.flatnonzero(ids == separator)
                head = int(ends[0]) if len(ends) else len(ids)
                out.append((len(ids), len(ends), head, len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids), np.diff(ends) - 1))
            counts = [pa.array([o[k] for o in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64()), *counts, pa.array([o[4] for o in out], pa.list_(pa.int64()))], ["file", "block", "ids", "ends", "head", "tail", "inside"])

    found = common.save(blocks.select("file", "block", "payload").mapInArrow(look, "file string, block long, ids long, ends long, head long, tail long, inside array<long>"), "ends")

    # for every block of a span: the separators and ids before it, and where its last separator before the block ends
    so_far = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("file", "span").orderBy("block")
    small = found.select("file", "block", F.floor(F.col("block") / span).alias("span"), "ids", "ends", "tail")
    small = small.withColumn("first_in", so_far(inside, "ends")).withColumn("ids_in", so_far(inside, "ids"))
    small = small.withColumn("end", F.when(F.col("ends") > 0, F.col("ids_in") + F.col("ids") - F.col("tail")))
    small = small.withColumn("end_in", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # the same for the spans of a file
    over = Window.partitionBy("file").orderBy("span")
    spans = small.groupBy("file", "span").agg(F.sum("ends").alias("ends"), F.sum("ids").alias("ids"), F.max("end").alias("end"), F.max("block").alias("last_block"))
    spans = spans.withColumn("first", so_far(over, "ends")).withColumn("ids_before", so_far(over, "ids"))
    spans = spans.withColumn("end_before", F.coalesce(F.max(F.col("ids_before") + F.col("end")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.select("file", "span", "first", "ids_before", "end_before", F.max("last_block").over(Window.partitionBy("file")).alias("last_block"))

    last_end = F.coalesce(F.col("ids_before") + F.col("end_in"), F.col("end_before"))
    before = small.join(spans, ["file", "span"]).select("file", "block", (F.col("first") + F.col("first_in")).alias("first"), (F.col("ids_before") + F.col("ids_in") - last_end).alias("carried"), (F.col("block") == F.col("last_block")).alias("is_last"))
    stitched = found.join(before, ["file", "block"])
    whole = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inside"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("head"))
    closed = F.transform(whole, lambda n, k: F.struct((F.col("first") + k).alias("ordinal"), n.alias("n_tokens"), F.lit(True).alias("closed")))
    open_ = F.when(F.col("is_last") & (rest > 0), F.array(F.struct((F.col("first") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))))
    return stitched.select("file", F.inline(F.concat(closed, F.coalesce(open_, F.array().cast("array<struct<ordinal: bigint, n_tokens: bigint, closed: boolean>>")))))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document: doc_id, n_tokens (without the separator)."""
    written = write_tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), json_path, block_ids)
    lengths = scan(written).where("closed")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = (
        written.select("file", "block", "doc_ids")
        .withColumn("first", F.coalesce(F.sum(F.size("doc_ids").cast("long")).over(before), F.lit(0)))
        .select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    )
    return names.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
