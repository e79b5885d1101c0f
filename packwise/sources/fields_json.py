"""Structured field JSON: reading extraction results, writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.functions.text import has_text
from packwise.schemas import BOOLEAN_FIELDS, LABEL_FIELDS

OLDER_FIELDS = ("manufacturing_date", "mfg_or_expiry_date", "expiry_date")

UNREADABLE = "_unreadable"

# Everything is read as text: a number where text is expected keeps its spelling.
FIELDS_DDL = ", ".join(
    f"{n} string" for n in (*LABEL_FIELDS, *OLDER_FIELDS, "raw_text", "product_folder")
)


def read_fields(spark: SparkSession, path: str, multi_line: bool = False,
                extra: str = "") -> tuple[DataFrame, DataFrame]:
    """Structured field files with their modification time, and the records that can't be read.

    The second frame has ``record`` (the text as it stands in the file), ``source_file`` and
    ``modified``; nothing is dropped.
    """
    ddl = FIELDS_DDL + (f", {extra}" if extra else "") + f", {UNREADABLE} string"
    text = (
        spark.read.option("wholetext", multi_line).option("recursiveFileLookup", True).text(path)
        .select("value", F.col("_metadata.file_path").alias("source_file"),
                F.col("_metadata.file_modification_time").alias("modified"))
        .filter(has_text(F.col("value")))
    )
    raw = text.withColumn("r", F.from_json(
        "value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}))
    bad = F.col("r").isNull() | F.col(f"r.{UNREADABLE}").isNotNull()
    good = raw.filter(~bad).select("r.*", "source_file", "modified").drop(UNREADABLE)
    return (
        good.withColumns({n: F.col(n).try_cast("boolean") for n in BOOLEAN_FIELDS}),
        raw.filter(bad).select(F.col("value").alias("record"), "source_file", "modified"),
    )


def latest_per_folder(fields: DataFrame) -> DataFrame:
    """Newest file of every product folder."""
    whole = F.struct(*fields.columns)
    return fields.groupBy("product_folder").agg(
        F.max_by(whole, F.struct("modified", "source_file")).alias("r")
    ).select("r.*")


def latest_folder(fields: DataFrame) -> DataFrame:
    """Rows of the folder written last."""
    newest = fields.agg(F.max_by("product_folder", F.struct("modified", "source_file")).alias("f"))
    return fields.join(
        F.broadcast(newest), F.col("product_folder").eqNullSafe(F.col("f"))
    ).drop("f")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
