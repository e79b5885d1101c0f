"""Sends the repository's packages to the executors, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the packages' modules as one archive, once per session; workers import them from there."""
    context = spark.sparkContext
    if getattr(context, "_packwise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="packwise-modules-"), "packwise_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for package in ("packwise", "workload"):
            for folder, _, names in os.walk(os.path.join(ROOT, package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        archive.write(whole, os.path.relpath(whole, ROOT))
    context.addPyFile(path)
    context._packwise_shipped = True
