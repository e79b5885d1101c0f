"""Image (im_*) queries. Pixels are the bytes of the documents, so sizes grow with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwise.operators import images as im
from workload.inputs import table
from workload.registry import query

# Width in pixels of an image made from a text; 3 bytes make a pixel.
WIDTH = 90

DUCK_IMAGES = f"""images AS (SELECT 'doc-' || doc_id AS origin, {WIDTH} AS width,
 (octet_length(encode(text)) // {3 * WIDTH}) + 20 + doc_id % 100 AS height FROM documents)"""


def images(spark, sf_dir):
    """Image rows as Spark's image source gives them, one per document."""
    rows = F.octet_length("text").cast("bigint")
    height = (F.floor(rows / (3 * WIDTH)) + 20 + F.col("doc_id") % 100).cast("int")
    padded = F.rpad(F.col("text").cast("binary"), height * 3 * WIDTH, F.lit(b"\x10\x80\xf0"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("origin"),
        height.alias("height"), F.lit(WIDTH).alias("width"), F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"), padded.alias("data"))


@query("im_quality")
def im_quality(spark, sf_dir):
    return im.quality(images(spark, sf_dir))


_SIZES = "sizes AS (SELECT doc_id, 300 + (doc_id * 37) % 3000 AS width, 200 + (doc_id * 91) % 2500 AS height FROM documents)"


@query("im_resize_plan", f"""WITH {_SIZES}, a AS (SELECT *, CASE WHEN greatest(width, height) > 1600
 THEN 1600::DOUBLE / greatest(width, height) ELSE 1 END AS s FROM sizes),
b AS (SELECT *, CASE WHEN least(width, height) < 600 AND least(width, height) * s < 900 THEN 900::DOUBLE / least(width, height)
 ELSE s END AS t FROM a), c AS (SELECT *, CASE WHEN abs(t - 1) < 0.001 THEN 1 ELSE t END AS u FROM b)
SELECT doc_id, round(u, 9) AS scale, CAST(greatest(1, round_even(width * u, 0)) AS INTEGER) AS new_width,
 CAST(greatest(1, round_even(height * u, 0)) AS INTEGER) AS new_height FROM c""")
def im_resize_plan(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", (300 + (F.col("doc_id") * 37) % 3000).alias("width"),
        (200 + (F.col("doc_id") * 91) % 2500).alias("height"))
    return im.resize_plan(sizes, 1600, 900).select(
        "doc_id", F.round("scale", 9).alias("scale"), "new_width", "new_height")


@query("im_triage", """WITH m AS (SELECT doc_id % 256 AS brightness, doc_id % 60 AS contrast, (doc_id * 13) % 500 AS blur,
 doc_id % 17 AS noise FROM documents) SELECT brightness < 70 OR contrast < 35 OR brightness < 110 AS fix_illumination,
 noise > 12 AS denoise, CASE WHEN blur < 300 THEN 'deblur' ELSE 'sharpen' END AS sharpening, count(*) AS images FROM m GROUP BY ALL""")
def im_triage(spark, sf_dir):
    d = F.col("doc_id")
    measured = table(spark, sf_dir, "documents").select(
        (d % 256).alias("brightness"), ((d * 13) % 500).alias("blur_score"),
        (d % 256 < 70).alias("is_dark"), (d % 60 < 35).alias("is_low_contrast"),
        ((d * 13) % 500 < 80).alias("is_blurry"), (d % 17 > 12).alias("is_noisy"))
    return im.triage_counts(measured)


@query("im_batch_rollup", """WITH v AS (SELECT doc_id // 3 AS product_id, CASE doc_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back'
 ELSE 'side' END AS view_name, CASE WHEN lang IS NULL THEN NULL WHEN n_chars < 300 THEN 'Image too small'
 WHEN lang <> 'en' THEN 'not processed' END AS problem FROM documents)
SELECT product_id, count(*) AS num_images, string_agg(view_name, ',' ORDER BY view_name) AS views,
 count(problem) AS failed, coalesce(string_agg(view_name || '=' || problem, ',' ORDER BY view_name) FILTER (problem IS NOT NULL), '') AS errors
FROM v GROUP BY product_id""")
def im_batch_rollup(spark, sf_dir):
    """English documents were processed, the short ones failed."""
    d = F.col("doc_id")
    manifest = table(spark, sf_dir, "documents").select(
        F.floor(d / 3).alias("product_id"),
        F.when(d % 3 == 0, "front").when(d % 3 == 1, "back").otherwise("side").alias("view"),
        F.when(F.col("n_chars") < 300, "Image too small").alias("error"), "lang")
    views = manifest.filter("error is not null or lang = 'en'").drop("lang")
    errors = F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return im.batch_rollup(manifest.drop("lang", "error"), views).select(
        "product_id", "num_images", F.array_join("views", ",").alias("views"), "failed",
        F.array_join(errors, ",").alias("errors"))
