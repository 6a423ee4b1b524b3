"""A folder of maps as a stream: each file of features by line becomes rows of the typed tables, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from calorgrid.sources import geojson

TABLES = ("objects", "parts", "notes")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, unknown_restriction: str = "skip", files_per_batch: int = 1000) -> StreamingQuery:
    """Follow a folder of GeoJSON files with one feature per line and write what they hold to `out`.

    A scene is a file, and a file is read in one batch, so that ids, parts and notes of a scene are complete. Each
    batch overwrites its own folder of each table: one that is run again after a failure leaves no row twice. The
    query stops when it has taken what is there; started again on the same checkpoint it goes on with new files.
    """
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where("trim(value) <> ''")
    scene = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[a-z]+)*$", 1)
    rows = rows.select(scene.alias("scene_id"), "value")

    def land(batch: DataFrame, number: int) -> None:
        feature = F.try_parse_json("value")
        seen = batch.select("scene_id", F.xxhash64("value").alias("seq"), F.lit(None).cast("string").alias("code"), feature.alias("feature"))
        found = geojson.normalise(seen, unknown_restriction)
        for name in TABLES:
            getattr(found, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """A stream of how many features of each type arrive in windows of ten minutes, by the time of their file; rows
    that come later than `delay` are left out, so that the state is bounded."""
    rows = spark.readStream.text(folder).select(F.col("_metadata.file_modification_time").alias("at"), F.try_parse_json("value").alias("feature"))
    kind = F.coalesce(geojson.value("$.properties.object_type"), F.lit(""))
    return rows.withWatermark("at", delay).groupBy(F.window("at", "10 minutes"), kind.alias("object_type")).agg(F.count("*").alias("n"))
