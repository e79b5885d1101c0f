"""Image tables from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: shortest side in pixels an image must have.
MIN_SIDE = 80


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted images and rejected ones with the reason."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return accept_images(raw.select("image.*"))


def image_error() -> Column:
    shape = F.concat_ws("x", "width", "height")
    return (
        F.when(F.coalesce("height", F.lit(-1)) < 1, F.concat(F.lit("Cannot read image: "), F.col("origin")))
        .when(F.col("nChannels") != 3, F.concat(
            F.lit("Expected 3-channel image, got "), F.col("nChannels").cast("string")
        ))
        .when(
            F.least("width", "height") < MIN_SIDE,
            F.concat(F.lit("Image too small ("), shape, F.lit(")")),
        )
    )


def accept_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split image rows (origin, height, width, nChannels, mode, data)."""
    judged = images.withColumn("error", image_error())
    return (
        judged.filter("error is null").drop("error"),
        judged.filter("error is not null").drop("data"),
    )
