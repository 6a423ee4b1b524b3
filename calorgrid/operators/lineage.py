"""Cutting the lineage of tables that grow in rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

LARGE = 1 << 20  # bytes of a written table beyond which no join sends it through the driver

_kept: list[tuple[SparkSession, str]] = []  # what this process has written, read until it ends


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="calorgrid-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _size(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def cut(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The table, written to the checkpoint folder and read back. Where the session names none a temporary one is set
    on a local master; on any other master that is an error, as executors share no local folder.

    A written table also tells the planner its size, but that of the files: keys and labels that take a byte a row there
    take many times that in memory, so a table beyond LARGE asks to be joined by a shuffle. Checkpoints keep the
    estimate of their plan, which in a loop of joins grows as a power with each round. `last`, the written table of the round before, is deleted once
    this one stands; nothing else may read it.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/rounds-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _size(spark, path) > LARGE:
        out = out.hint("merge")
    out._written = path
    if last is not None:
        _drop(spark, last._written)
        _kept.remove((spark, last._written))
    return out


@atexit.register
def _delete() -> None:
    for spark, path in _kept:
        try:
            _drop(spark, path)
        except (AttributeError, OSError, PySparkException):  # the session has ended before: its folder goes with it
            return
