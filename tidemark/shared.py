"""The folder that the driver and all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`; only on a single machine, where it is unset, under a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shipped(spark: SparkSession) -> None:
    """Make this package known to the executors' Python, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_shipped_tidemark", False):
        top = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ship-')}/{top.name}_library", "zip", top.parent, top.name))
        context._shipped_tidemark = True


def once(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: what several branches of a plan read is computed once."""
    shared_path(df.sparkSession, "once")
    return df.checkpoint()
