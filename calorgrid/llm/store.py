"""The shared folder of a session, tables and files written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

_kept: list[tuple[SparkSession, str]] = []  # folders of results, which are read until the process ends


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named a temporary one is set on a local master,
    whose tasks share it; on any other master that is an error, as each executor would have a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="calorgrid-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_results() -> None:
    for spark, path in _kept:
        try:
            delete(spark, path)
        except (AttributeError, OSError, PySparkException):  # the session has ended before: its folder goes with it
            return


def cut(df: DataFrame, name: str = "table", group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, executors may be lost. `group` is the number
    of rows of a row group of a table of very large rows: a reader takes up to 4096 rows of a group in one batch."""
    path, writer = new_path(df.sparkSession, name), df.write
    if group:
        writer = writer.option("parquet.block.row.count.limit", group)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one call, in one folder. They are deleted one by one as soon as no later
    step reads them, and all at the end of the `with` block; what the call returns must not read them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.tables = spark, new_path(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.tables.pop(id(t))[1])


def write_blobs(df: DataFrame, column: str, path: str, end: str, compression: str = "none", rows_per_file: int = 0) -> None:
    """Write one file per partition, or more of at most `rows_per_file` rows: the bytes of each row, then `end`.

    Spark's own text sink does the writing, so files appear only when their task has committed and any
    Hadoop file system will do. The sink copies the bytes of a string unchanged; a binary column is cast
    to string, which keeps its bytes.
    """
    lines = df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end)
    lines.option("compression", compression).option("maxRecordsPerFile", rows_per_file).text(path)
