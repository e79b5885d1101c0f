"""Image quality and planning tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx

# Thresholds of the quality flags and of the enhancement plan.
DARK, BRIGHT, LOW_CONTRAST, BLURRY, NOISY, LOW_SIDE = 70.0, 200.0, 35.0, 80.0, 12.0, 600
DIM, SOFT = 110.0, 300.0

METRICS = ("brightness", "contrast", "blur_score", "noise_estimate")


def _gray(pixels: np.ndarray) -> np.ndarray:
    """8-bit luma of BGR rows."""
    b, g, r = (pixels[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b)


def _measure(gray: np.ndarray) -> list[float]:
    """Mean, deviation, Laplacian variance, mean distance to a 5x5 binomial blur."""
    edge = np.pad(gray, 1, mode="reflect")
    laplace = (
        edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * gray
    )
    weights = np.array([1, 4, 6, 4, 1]) / 16.0
    wide = np.pad(gray, 2, mode="reflect")
    rows = sum(w * wide[i:i + gray.shape[0], :] for i, w in enumerate(weights))
    blurred = np.rint(sum(w * rows[:, i:i + gray.shape[1]] for i, w in enumerate(weights)))
    return [gray.mean(), gray.std(), laplace.var(), np.abs(gray - blurred).mean()]


def quality(images: DataFrame) -> DataFrame:
    """Brightness, contrast, sharpness and noise of BGR image rows, with flags.

    Pixels are measured in small Arrow batches inside tasks; only numbers leave them.
    """
    wanted = images.select("origin", "width", "height", "nChannels", "data")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, width, height, channels, data in batch.itertuples(index=False, name=None):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                gray = _gray(pixels) if channels >= 3 else pixels[..., 0].astype(np.float64)
                rows.append((origin, width, height, *map(float, _measure(gray))))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", *METRICS])

    ddl = "origin string, width int, height int, " + ", ".join(f"{m} double" for m in METRICS)
    measured = wanted.mapInPandas(measure, ddl)
    return measured.withColumns({
        "is_dark": F.col("brightness") < DARK,
        "is_bright": F.col("brightness") > BRIGHT,
        "is_low_contrast": F.col("contrast") < LOW_CONTRAST,
        "is_blurry": F.col("blur_score") < BLURRY,
        "is_noisy": F.col("noise_estimate") > NOISY,
        "is_low_res": F.least("width", "height") < LOW_SIDE,
    }).withColumns({m: tx.round_exact(F.col(m), 2) for m in METRICS})


def resize_plan(images: DataFrame, max_side: int | None, min_side: int | None) -> DataFrame:
    """Scale and target size; ``min_side`` applies to low-resolution images only."""
    longer, shorter = F.greatest("width", "height"), F.least("width", "height")
    scale = F.lit(1.0)
    if max_side is not None:
        scale = F.when(longer > max_side, F.lit(float(max_side)) / longer).otherwise(scale)
    if min_side is not None:
        low = shorter < LOW_SIDE
        scale = F.when(
            low & (shorter * scale < min_side), F.lit(float(min_side)) / shorter
        ).otherwise(scale)
    planned = images.withColumn("scale", F.when(F.abs(scale - 1.0) < 1e-3, 1.0).otherwise(scale))

    def side(name: str):
        # Halves go to the even neighbour.
        return F.greatest(F.lit(1), F.bround(F.col(name) * F.col("scale")).cast("int"))

    return planned.withColumns({"new_width": side("width"), "new_height": side("height")})


def triage(measured: DataFrame) -> DataFrame:
    """Which enhancements each image needs."""
    dim = F.col("is_dark") | F.col("is_low_contrast") | (F.col("brightness") < DIM)
    soft = F.col("is_blurry") | (F.col("blur_score") < SOFT)
    return measured.withColumns({
        "fix_illumination": dim,
        "denoise": F.col("is_noisy"),
        "sharpening": F.when(soft, "deblur").otherwise("sharpen"),
    })


def triage_counts(measured: DataFrame) -> DataFrame:
    return triage(measured).groupBy("fix_illumination", "denoise", "sharpening").agg(
        F.count("*").alias("images")
    )


def batch_rollup(manifest: DataFrame, views: DataFrame) -> DataFrame:
    """Images, views and failures per product; a failed view does not stop the others.

    ``manifest`` has one row per expected (product_id, view), ``views`` the processed ones
    with an optional ``error``; of several errors of one view the alphabetically first is told.
    """
    seen = views.groupBy("product_id", "view").agg(F.min("error").alias("error"))
    done = manifest.dropDuplicates(["product_id", "view"]).join(
        seen.withColumn("_seen", F.lit(True)), ["product_id", "view"], "left")
    problem = F.when(F.col("_seen").isNull(), "not processed").otherwise(F.col("error"))
    failed = F.when(problem.isNotNull(), F.struct("view", problem.alias("error")))
    # A product has at most one row per view name.
    return done.groupBy("product_id").agg(
        F.count("*").alias("num_images"),
        F.array_sort(F.collect_set("view")).alias("views"),
        F.count_if(problem.isNotNull()).alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_set(failed))).alias("errors"),
    )
