"""Command line: `python -m calorgrid audit MAPS OUT`, `verify MAPS RESULTS OUT`, `report MAPS RESULTS OUT`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from calorgrid.operators import verify
from calorgrid.sources import geojson, write


def audit(spark: SparkSession, args) -> None:
    """Counts per map, and its notes, as JSON."""
    scenes = geojson.normalise(geojson.documents(spark, args.maps))
    demand = F.col("object_type") == "oks_connection_point"
    counts = scenes.objects.groupBy("scene_id").agg(F.count_if(demand).alias("demands"), F.count_if(~F.col("valid")).alias("invalid"), F.sum("flow").alias("total_flow"))
    points = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))
    holes = F.when(F.col("dim") == 2, F.size("rings") - 1).otherwise(0)
    shapes = scenes.parts.groupBy("scene_id").agg(F.count("*").alias("parts"), F.sum(holes).alias("holes"), F.sum(points).alias("coordinates"))
    notes = write.shown(scenes.notes, ["scene_id"]).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("code", "id", "said", "total"))).alias("notes"))
    counts.join(shapes, "scene_id", "full").join(notes, "scene_id", "full").write.json(args.out)


def _verified(spark: SparkSession, args):
    scenes = geojson.normalise(geojson.documents(spark, args.maps))
    result = verify.result(geojson.documents(spark, args.results))
    return scenes, result, verify.verify(scenes, result)


def check(spark: SparkSession, args) -> None:
    """A JSON report of violations per map."""
    scenes, result, found = _verified(spark, args)
    write.reports(scenes.objects, found, result.summaries.select("scene_id", "rank", "score", "calculated_cost", "new_network_length"), args.out)


def report(spark: SparkSession, args) -> None:
    """An HTML report per map: the map, new pipes in red, and its variants."""
    scenes = geojson.normalise(geojson.documents(spark, args.maps))
    result = verify.result(geojson.documents(spark, args.results))
    old = scenes.parts.select("scene_id", "id", "dim", "rings").withColumn("style", F.lit("gray"))
    new = result.lines.select("scene_id", "id", F.lit(1).alias("dim"), F.array("points").alias("rings"), F.lit("red").alias("style"))
    variants = result.summaries.select("scene_id", "rank", "score", F.col("calculated_cost").alias("cost"), F.col("new_network_length").alias("length"))
    write.html(old.union(new), variants, args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="calorgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run, places in (("audit", audit, ("maps", "out")), ("verify", check, ("maps", "results", "out")), ("report", report, ("maps", "results", "out"))):
        one = commands.add_parser(name, help=run.__doc__)
        for p in places:
            one.add_argument(p)
        one.set_defaults(run=run)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("calorgrid").getOrCreate(), args)


if __name__ == "__main__":
    main()
