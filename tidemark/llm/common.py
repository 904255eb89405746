"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_HOLDERS: dict[int, list] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only on a single machine, where it is unset, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a query go as soon as it ends; the setting returns once the last user leaves."""
    key = id(spark)
    with _LOCK:
        if key not in _HOLDERS:
            _HOLDERS[key] = [0, spark.conf.get(SHUFFLE_CLEANUP, None)]
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _HOLDERS[key][0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _HOLDERS[key][0] -= 1
            if not _HOLDERS[key][0]:
                before = _HOLDERS.pop(key)[1]
                if before is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder.

    Nothing reads the shuffle files behind it any more, so they go as soon as it is written; else they would stay on the
    executors' disks until the driver collects its garbage. The plan is made anew for this (`select`), so df stays usable.
    """
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


class Tables:
    """Tables of one operator, written as Parquet to the shared folder; each can go as soon as nothing needs it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        with shuffles_removed(self.spark):
            df.write.parquet(path, compression="lz4")
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][1])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fold_of(column: str, folds: int):
    """crc32 of the id written as text, modulo folds (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def hashed_share(column: str, share: float, seed: int):
    """True for about this share of the ids, the same ones in every run."""
    scale = 1 << 40
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(scale)) < F.lit(int(share * scale))


def text_batches(batches, rows: int = 512):
    """Cut Arrow batches into slices of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapped(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(function, schema) with this package made known to the executors' Python first."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_shipped_package", None) != __package__:
        top = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ship-')}/{top.name}", "zip", top.parent, top.name)
        context.addPyFile(archive)
        context._shipped_package = __package__
    return df.mapInArrow(function, schema)
