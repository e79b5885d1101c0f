"""Token ids of a corpus in binary segments, in ascending order of the documents.

``write_store`` encodes every whole text, ends each document with ``end_id`` and writes segments:
rows of a Parquet table whose ``words`` column is one Simple-8b stretch of whole documents, beside
their ids and lengths. ``read_store`` decodes them. Spark's writer commits the table, so a lost
executor's tasks are simply run again.

Defined results: a null text is an empty one (its document is the end id alone); rows without
doc_id come first; rows of one doc_id stay apart, ordered by a hash of the text; an empty table
gives an empty store; other columns are not read. A document's ids lie in one segment, which is
as long as the document needs, else closed at ``SEGMENT`` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwise.llm import simple8b
from packwise.llm.common import blocks, col
from packwise.llm.segments import segments, text_bytes, with_end

SEGMENT = 1 << 17
STORE = ("part int, segment int, first long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
         "words binary")
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary())])


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, blanks: bool = False) -> None:
    """Writes the segments of docs(doc_id, text) to ``path``; ``vocabulary`` is a tokenizer file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segments(vocabulary, blanks)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        for batch in blocks(batches, "text"):
            ids, counts = with_end(*encoder.encode(text_bytes(batch.column("text"))), end_id)
            doc_ids, lengths = batch.column("doc_id").to_pylist(), counts.tolist()
            upto = np.concatenate(([0], np.cumsum(counts))).tolist()
            a = 0
            while a < len(doc_ids):
                b = a + 1
                while b < len(doc_ids) and upto[b + 1] - upto[a] <= SEGMENT:
                    b += 1
                n = upto[b] - upto[a]
                words = simple8b.encode(ids[upto[a]:upto[b]])
                row = ([part], [segment], [first], [n], [doc_ids[a:b]], [lengths[a:b]], [words])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _ARROW.types)], schema=_ARROW)
                segment, first, a = segment + 1, first + n, b
        encoder.forget()

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    # Ties are split too: rows that are equal throughout may change places, nothing depends on it.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"k1": keys[1], "k2": keys[2]})
    order = [keys[0], F.col("k1"), F.col("k2")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(store, STORE).write.parquet(path)


def open_store(spark, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def read_store(store: DataFrame) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens and its ids as little-endian 32-bit integers."""
    return _read(store, True)


def digest_store(store: DataFrame) -> DataFrame:
    """As read_store, with the CRC-32 of each document's ids for the ids themselves."""
    return _read(store, False)


def _read(store: DataFrame, whole: bool) -> DataFrame:
    last = ("ids", pa.binary()) if whole else ("ids_crc32", pa.int64())
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), last])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, doc_ids, lengths, words = (
                    batch.column(c)[row].as_py() for c in ("part", "first", "doc_ids", "lengths", "words"))
                ids = memoryview(simple8b.decode(words).astype("<u4")).cast("B")
                upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                each = [ids[4 * a:4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                values = [bytes(x) if whole else zlib.crc32(x) for x in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()),
                     pa.array(first + upto[:-1]), pa.array(lengths, pa.int64()), pa.array(values, last[1])],
                    schema=schema)

    kind = "ids binary" if whole else "ids_crc32 long"
    docs = store.mapInArrow(read, f"part int, doc_id long, start long, n_tokens long, {kind}")
    # One row for each partition of the writing job, whatever the corpus holds.
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", docs.columns[-1])
