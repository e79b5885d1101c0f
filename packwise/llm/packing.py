"""Packing without padding: each document cut into pieces of power-of-two lengths.

A document's ids and the end id make floor(n / width) pieces of full width and, for the rest, one
piece for each bit of its length, longest first. A piece is a sequence of its own; sequences of a
length make a bucket, and batches are drawn from one bucket, so no sequence crosses documents and
none needs padding. sequence_id has the bucket (log2 of the length) in its top bits, then the task
and the place in the task, so sorting by it gathers the buckets; one narrow pass, nothing moves.

Defined results: a null text is an empty one (the end id alone); rows of one doc_id stay apart;
a null doc_id is kept; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from packwise.llm.common import blocks, col
from packwise.llm.segments import segments, text_bytes, with_end

WIDTH = 1024
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset")] + [("ids", pa.binary())])
TASK_BITS, PLACE_BITS = 24, 34


def piece_lengths(n: int, width: int) -> list[int]:
    rest = n % width
    return [width] * (n // width) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int, width: int = WIDTH, blanks: bool = True) -> DataFrame:
    """The pieces of docs(doc_id, text), with their ids as little-endian 32-bit integers."""
    if width < 1 or width & (width - 1):
        raise ValueError("the width must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segments(vocabulary, blanks)
        task, place = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text"):
            ids, counts = with_end(*encoder.encode(text_bytes(batch.column("text"))), end_id)
            cut = [piece_lengths(n, width) for n in counts.tolist()]
            each = np.array([len(c) for c in cut], np.int64)
            lengths = np.array([x for c in cut for x in c], np.int64)
            ends = np.cumsum(lengths)
            before = np.repeat(np.cumsum(counts) - counts, each)
            data = memoryview(ids.astype("<u4")).cast("B")
            bounds = [0, *(4 * ends).tolist()]
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])), np.int64, len(lengths))
            bucket = np.log2(lengths).astype(np.int64)
            sequence = (bucket << (TASK_BITS + PLACE_BITS)) + (task << PLACE_BITS) + place + np.arange(len(lengths))
            place += len(lengths)
            doc_ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(cut)), each)))
            binary = pa.Array.from_buffers(pa.binary(), len(lengths),
                                           [None, pa.py_buffer(np.array(bounds, np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(ends - lengths - before), pa.array(lengths), pa.array(crc),
                 pa.array(np.repeat(counts, each)), pa.array(sequence),
                 pa.array(np.zeros(len(lengths), np.int64)), binary], schema=_ARROW)
        encoder.forget()

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a trainer draws batches of one shape."""
    pieces.withColumn("bucket", pieces["length"]).write.partitionBy("bucket").parquet(path)
