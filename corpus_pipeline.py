"""The corpus pipeline: from raw documents to training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes and reads again as
the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packwise.llm import decontam, langid, line_dedup, packing, simhash  # noqa: E402
from packwise.llm.common import col, written  # noqa: E402
from packwise.llm.queries import BYTE_BPE, BYTE_END, learnable  # noqa: E402
from packwise.shipping import ship  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; the others go."""
    told = langid.identify(docs, langid.learn(learnable(docs)))
    return told.where(col(told.columns[-1])).select(*map(col, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and n_chars follows the text; a document of which no line is left goes too."""
    kept = line_dedup.drop_repeated_lines(docs)
    n_dropped = col(kept.columns[-1])
    kept = kept.where((n_dropped == 0) | (col("text") != ""))
    n_chars = F.char_length(col("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their ids."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), BYTE_END)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return work


STAGES: list[tuple[str, Stage]] = [
    (stage.__name__, _shipped(stage)) for stage in (language, lines, near_duplicates, benchmark_free, packed)
]

#: Compression, fingerprints and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
