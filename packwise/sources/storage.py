"""Shared scratch space for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own; the
    session's settings stay as they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = getattr(context, "_packwise_folder", None)
    if folder is None:
        folder = context._packwise_folder = tempfile.mkdtemp(prefix="packwise-")
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """A written table in the shared folder, divided by the columns ``folders``: what follows reads it
    instead of computing it again."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever it lies; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def move_folders(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """The folders of ``source`` whose names begin so take the place of those of ``target``. No file is written again,
    and what is moved already stays, so this may be done again after it was stopped."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in place.listStatus(path(source)) if place.exists(path(source)) else ():
        name = found.getPath().getName()
        if name.startswith(prefix):
            old = path(path(target), name)
            place.delete(old, True)
            if not place.rename(found.getPath(), old):
                raise OSError(f"{found.getPath()} can't be moved to {old}")
