"""Scoring, daily counts and repeat suppression over arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packwise.operators.compliance import check
from packwise.sources.rules import RuleSet
from packwise.sources.storage import new_folder


def score_stream(labels: DataFrame, rules: RuleSet) -> DataFrame:
    """Score label rows as they arrive: stateless, rule tables joined by broadcast."""
    return check(labels, rules)


def daily_stream(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Inspections and compliant ones per day and category, for update mode.

    Rows later than the watermark are dropped, and so is the state of days before it.
    """
    timed = records.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day"), "product_type")
        .agg(F.count("*").alias("inspections"), F.count_if("is_compliant").alias("compliant"))
        .select(F.to_date("window.start").alias("day"), "product_type", "inspections", "compliant")
    )


def dedup_stream(records: DataFrame, key: str = "inspection_id", late: str = "1 day") -> DataFrame:
    """First sighting of every inspection; state is bounded by the watermark."""
    timed = records.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def write_unseen(batch: DataFrame, number: int, target: str, key: str, time: str) -> None:
    """Writes the rows of a batch whose key no earlier batch has, the first of each key by ``time``.

    A batch owns the folder of its number and looks at those before it alone, so running it again
    writes the same rows.
    """
    spark = batch.sparkSession
    schema = StructType([*batch.schema.fields, StructField("batch", LongType())])
    seen = spark.read.schema(schema).parquet(target).where(F.col("batch") < number).select(F.col(key).alias("_seen"))
    row = F.struct(*batch.columns)
    first = batch.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(F.col(time).isNull(), time, F.xxhash64(row))).alias("row"))
    unseen = first.join(seen, F.col("_key").eqNullSafe(F.col("_seen")), "left_anti")
    unseen.select("row.*").write.mode("overwrite").parquet(f"{target}/batch={number}")


def run_unique(stream: DataFrame, name: str, key: str = "inspection_id", time: str = "created_at") -> DataFrame:
    """Drains what has arrived into a table of first sightings and reads it back, however late a repeat comes.

    The table itself is the registry of keys: each batch is reduced to the first row of a key and joined against
    the keys of the batches before. Nothing is kept in the stream's state, and no row is too late to count.
    """
    spark = stream.sparkSession
    target, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-state")
    spark.createDataFrame([], stream.schema).write.parquet(f"{target}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        write_unseen(batch, number, target, key, time)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        write).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(target).drop("batch")


def run_to_table(stream: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drain what has arrived into a parquet table and read it back.

    With ``keys``, the stream brings a key's newest figures again and again (update mode): each
    batch's changed rows replace the folder of that batch, so a batch that is run again writes
    nothing twice, and a key's row of the latest batch counts.
    """
    spark = stream.sparkSession
    target, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if not keys:
        writer.format("parquet").option("path", target).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{target}/batch=-1")
    writer.foreachBatch(write).outputMode("update").start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(target)
    row = F.struct(*stream.columns)
    return rows.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select("row.*")
