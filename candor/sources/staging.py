"""Intermediate tables: written once to the folder that all executors share, and read as often as needed.

A table survives the loss of an executor, cuts the lineage, and needs no memory that somebody has to release.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A side of a join is broadcast only if its counted rows need at most this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


class NoSharedFolder(RuntimeError):
    pass


@functools.cache
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="candor-")
    atexit.register(shutil.rmtree, found, True)
    return f"file://{found}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and Spark runs in this process alone, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = _own_dir()
    if not found:
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, rows_a_file: int = 0, batch_bytes: int = 0) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and kept if an executor is lost.

    rows_a_file keeps files of texts small: a file that compresses well is else read by a single task, however long its texts are.
    batch_bytes keeps Arrow batches of texts small: an executor and its worker each hold a batch a task, and the executor some copies.
    Nothing else reads the shuffle files of the write, so they go with its end and not when the driver's memory is tidied.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    wanted = {_SHUFFLE_CLEANUP: "true"} | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, row_bytes: int, more: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks the frame for broadcast if its rows, and `more` bytes of each, are counted and fit the limit; else Spark shuffles it."""
    rows, extra = df.agg(F.count(F.lit(1)), F.sum(more) if more is not None else F.lit(0)).first()
    return F.broadcast(df) if rows * row_bytes + (extra or 0) <= limit else df
