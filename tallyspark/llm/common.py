"""What the operators of this subpackage share: shipping code, checkpoints, Arrow slices, memory of workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 1024


def ship(spark: SparkSession) -> None:
    """Give executors this package (once a session), so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark"), "tallyspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tallyspark", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._tallyspark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one in local mode; an error on a cluster."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_tallyspark_local"):
        sc._tallyspark_local = tempfile.mkdtemp(prefix="tallyspark-checkpoint")
    return sc._tallyspark_local


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files (an eager checkpoint).

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when df is no longer used; otherwise they
    stay until the folder is emptied.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release() -> None:
    """Give what a Python worker has freed back to the system: idle workers, which Spark keeps, would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, and release() at their end."""
    try:
        yield from batches
    finally:
        release()


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = ROWS
) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, which bounds a Python worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(lambda it: releasing(run(it)), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
