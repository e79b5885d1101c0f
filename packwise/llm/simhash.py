"""Near-duplicate documents by SimHash, links proven with pivot distance tables.

Fingerprints: majority bits over the hashes of all word shingles. Links: pairs of distinct
fingerprints with at most ``max_bits`` differing bits. Candidates come from bands: of ``bands``
bit fields, such a pair agrees on at least ``bands - max_bits``, so it meets under one of the
combinations of that many fields; nothing is missed. In a meeting the pivot table decides: every
fingerprint carries its Hamming distances to ``PIVOTS`` fixed reference fingerprints, a pair whose
largest coordinate difference is over ``max_bits`` can't be a link (triangle inequality) and is
discarded, and the survivors are verified bit by bit. (The table alone would leave about one pair
in two for each pivot, which is why it doesn't bring pairs together by itself.)

Documents of one fingerprint are one node, so exact copies cost nothing; meetings that stay large
are cut into parts, every two of which meet in a task of their own; a task links what it can't
tell apart only once (a spanning forest, not all pairs). Components are counted over nodes.

Defined results: null or blank text has fingerprint zero, linked like any other; rows of one
doc_id are one document; rows without doc_id get a fingerprint but no component and link nothing;
an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import col, written
from packwise.llm.components import components

SHINGLE, MAX_BITS, BANDS, PIVOTS = 4, 4, 6, 16
SEED = 42
#: Fingerprints of a meeting that one task compares with each other; larger meetings are cut.
PART = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n_words = b" ".join(words), len(words)
    del words
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(joined)]))[min(shingle, n_words) - 1:]
    digest = xxhash.xxh64_intdigest
    n = len(ends)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):  # bounded memory for texts of any length
        spans = zip(starts[a:a + 65_536].tolist(), ends[a:a + 65_536].tolist())
        some = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64)
        counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    @pandas_udf("long")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            prints = np.fromiter((fingerprint(t, shingle) for t in batch), np.uint64, len(batch))
            yield pd.Series(prints.view(np.int64))

    return docs.select(col("doc_id").cast("long").alias("doc_id"), signed(col("text")).alias("fp"))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, the same in every run."""
    return [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(n)]


def band_fields(bands: int) -> list[int]:
    """Bit masks of equal fields that cover 64 bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray, table: np.ndarray,
           max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by group; side tells the two parts of a cut meeting apart."""
    order = np.lexsort((table[:, 0], group))
    group, side, fp, node, table = group[order], side[order], fp[order], node[order], table[order]
    first = table[:, 0].astype(np.int16)
    label = np.arange(len(fp))
    here = np.arange(len(fp))
    for lag in range(1, len(fp)):
        # Sorted by the first coordinate: a row's partners end where it differs by more than max_bits.
        here = here[here + lag < len(fp)]
        near = (group[here + lag] == group[here]) & (first[here + lag] - first[here] <= max_bits)
        here = here[near]
        if not len(here):
            break
        a, b = here, here + lag
        open_ = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = a[open_], b[open_]
        far = np.abs(table[a, 1:].astype(np.int16) - table[b, 1:].astype(np.int16)).max(axis=1, initial=0)
        a, b = a[far <= max_bits], b[far <= max_bits]
        real = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        a, b = a[real], b[real]
        if len(a):
            while True:  # smallest label wins, until every link agrees
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                if (label[a] == label[b]).all():
                    break
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return node[tied], node[label[tied]]


def link(nodes: DataFrame, max_bits: int = MAX_BITS, bands: int = BANDS, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (u, v) that connect nodes(node, fp) as all pairs within max_bits do."""
    fields = band_fields(bands)
    keys = [sum(c) for c in itertools.combinations(fields, bands - max_bits)]
    refs = pivots(n_pivots)
    table = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))))), 2, "0"))
                       for p in refs])
    meeting = F.explode(F.array(*[
        F.struct(F.lit(i).cast("byte").alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("key"))
        for i, k in enumerate(keys)])).alias("at")
    met = nodes.select("node", "fp", meeting).select("node", "fp", "at.band", "at.key")
    sizes = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    # Row i of a cut meeting goes to the tasks (i, j) of all parts j; in a task of two parts, only
    # pairs across them are compared, pairs within a part in its task (i, i).
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(
        F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        .cast("byte").alias("side"), "node", "fp")
    met = met.repartition("task").sortWithinPartitions("task").withColumn("pivots", table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            task, side, node, fp = (rows.column(c).to_numpy() for c in ("task", "side", "node", "fp"))
            packed = rows.column("pivots").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            seen = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(node), n_pivots)
            u, v = _links(task, side, fp.view(np.uint64), node, seen, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            task = batch.column("task").to_numpy()
            cut = len(task) if not len(task) else int(np.searchsorted(task, task[-1]))
            if cut:
                yield found(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            if cut < len(task):
                rest.append(batch.slice(cut))
        if rest:
            yield found(pa.Table.from_batches(rest))

    return met.mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (hex) and component_id."""
    prints = written(fingerprints(docs, shingle), "simhash")
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # A doc_id with several texts ties their fingerprints together; a node is named by its smallest doc_id.
    twins = (prints.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").join(prints.distinct(), "doc_id").join(nodes, "fp")
             .select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    found = components(link(nodes, max_bits).union(twins))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: the smallest doc_id. Rows without doc_id stay."""
    stay = near_duplicates(docs, shingle, max_bits).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(col("doc_id").isNotNull())
    kept = named.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*map(col, docs.columns))
    return kept.unionByName(docs.where(col("doc_id").isNull()))
