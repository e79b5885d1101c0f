"""Corpus-wide removal of repeated lines.

Every line that counts (its key, stripped and lower-cased in ASCII, has ``min_chars`` code points)
is exploded to two 64-bit hashes of the key and the document's id, once per document. A key found
in ``min_docs`` documents is repeated; all documents but the one of the largest id lose its lines.
The keys to lose are gathered per document as hashes, and the text is put together again from the
lines that stay, in their order. Texts move once (to meet their lists); lines move as hashes only.

Defined results: null and empty texts are one empty line; documents are told apart by doc_id, so
rows of one doc_id are one document and lose the same lines; rows without doc_id keep their text
and don't count; an empty table stays empty; other columns are kept as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import ASCII_SPACE, col, fresh, lower_ascii

MIN_CHARS, MIN_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def hashes_of(key: Column) -> Column:
    """128 bits of a key: two hashes that start from different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line the hashes of its key, null for a line that doesn't count."""
    return F.transform(F.transform(lines_of(text), key_of),
                       lambda k: F.when(F.char_length(k) >= min_chars, hashes_of(k)))


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document that loses lines: doc_id and the hashes of their keys."""
    seen = (
        docs.where(col("doc_id").isNotNull())
        .select(col("doc_id").alias("doc_id"),
                F.explode(F.array_distinct(F.array_compact(line_hashes(col("text"), min_chars)))).alias("h"))
        .select("doc_id", "h.a", "h.b")
    )
    repeated = (
        seen.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("a", "b", "keeper")
    )
    lost = seen.join(repeated, ["a", "b"]).where(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("lost"))


def kept(text: str | None, a, b, lost_a, lost_b) -> tuple[str, int, int]:
    """The text that stays, its number of lines before and the number dropped.

    a and b are the hashes of its lines, lost_a and lost_b those of the keys that go (null for none).
    """
    lines = (text or "").split("\n")
    if lost_a is None:
        return text or "", len(lines), 0
    gone = set(zip(lost_a.tolist(), lost_b.tolist()))
    stay = [x for x, h in zip(lines, zip(a.tolist(), b.tolist())) if h not in gone]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text that stays, n_lines (before dropping) and n_dropped; under longer names on a clash."""

    @pandas_udf("kept string, n_lines long, n_dropped long")
    def kept_lines(texts: pd.Series, a: pd.Series, b: pd.Series, lost_a: pd.Series, lost_b: pd.Series) -> pd.DataFrame:
        rows = [kept(*x) for x in zip(texts, a, b, lost_a, lost_b)]
        return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

    kept_lines = kept_lines.asNondeterministic()  # else a filter on its result makes it run twice
    lost = lost_lines(docs, min_chars, min_docs)
    n_lines, n_dropped, gone, key, own = fresh(docs, "n_lines", "n_dropped", "_lost", "_lost_id", "_hashes")
    lost = lost.select(F.col("doc_id").alias(key), F.col("lost").alias(gone))
    both = docs.join(lost, col("doc_id") == F.col(key), "left")
    # Lines that don't count get zeros, which no list holds: pandas would read long beside null as double.
    zero = F.lit(0).cast("long")
    hashes = F.when(F.col(gone).isNotNull(), line_hashes(col("text"), min_chars))
    both = both.withColumn(own, hashes)
    sides = [F.transform(own, lambda h: F.coalesce(h[side], zero)) for side in ("a", "b")]
    both = both.withColumn(own, kept_lines(
        col("text"), *sides, F.col(gone)["a"], F.col(gone)["b"]))
    columns = [F.col(own)["kept"].alias(c) if c.lower() == "text" else col(c) for c in docs.columns]
    return both.select(*columns, F.col(own)["n_lines"].alias(n_lines), F.col(own)["n_dropped"].alias(n_dropped))
