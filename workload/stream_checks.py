"""Streaming queries (st_*): what has arrived is drained into a table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwise.sources.rules import load_rules
from packwise.sources.storage import new_folder
from packwise.streaming import jobs
from workload.inputs import DUCK_LABELS, label_fields
from workload.registry import query
from workload.rule_checks import DUCK_RESULT


def _arriving(spark, sf_dir, columns=None, copies: int = 1):
    """Label rows as files in a folder, read as a stream of one batch for each copy."""
    labels = label_fields(spark, sf_dir)
    labels = labels.select(*columns) if columns else labels
    path = new_folder(spark, "arriving")
    for _ in range(copies):
        labels.repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(labels.schema)
    return (stream.option("maxFilesPerTrigger", 4) if copies > 1 else stream).parquet(path)


@query("st_score", f"""WITH {DUCK_RESULT} SELECT inspection_id, score, is_compliant, summary, n AS violations FROM result""")
def st_score(spark, sf_dir):
    scored = jobs.score_stream(_arriving(spark, sf_dir), load_rules(spark)).select(
        "inspection_id", "score", "is_compliant", "summary",
        F.size("violations").cast("bigint").alias("violations"))
    return jobs.run_to_table(scored, "scored")


@query("st_daily", f"""WITH {DUCK_LABELS} SELECT CAST(created_at AS DATE) AS day, product_type, count(*) AS inspections,
 count(*) FILTER (is_imported) AS compliant FROM label_fields GROUP BY 1, 2""")
def st_daily(spark, sf_dir):
    stream = _arriving(spark, sf_dir, ["created_at", "product_type", F.col("is_imported").alias("is_compliant")])
    return jobs.run_to_table(jobs.daily_stream(stream), "daily", keys=("day", "product_type"))


@query("st_dedup", f"WITH {DUCK_LABELS} SELECT inspection_id, created_at FROM label_fields")
def st_dedup(spark, sf_dir):
    """Every inspection arrives in two batches and is kept once."""
    stream = _arriving(spark, sf_dir, ["inspection_id", "created_at"], copies=2)
    return jobs.run_to_table(jobs.dedup_stream(stream, late="40 days"), "unique")


@query("st_unique", f"WITH {DUCK_LABELS} SELECT inspection_id, created_at FROM label_fields")
def st_unique(spark, sf_dir):
    """Every inspection arrives again months later, far beyond any watermark, and its first sighting is kept."""
    labels = label_fields(spark, sf_dir).select("inspection_id", F.col("created_at").cast("timestamp").alias("created_at"))
    path = new_folder(spark, "arriving")
    for months in (0, 4, 9):
        later = F.expr(f"created_at + make_interval(0, {months})").alias("created_at")
        labels.select("inspection_id", later).repartition(4).write.mode("append").parquet(path)
    stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return jobs.run_unique(stream, "unique").select("inspection_id", "created_at")
