"""Writers: results as GeoJSON, reports as JSON and HTML, snapshots, and maps of any size for measurements.

A document is rows of text in order; each scene is written by one task as a stream, and no document is ever put
together in memory. Files appear when their task has committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from calorgrid.functions import geometry

MOST_OF_CODE, MOST = 20, 500  # warnings that a report shows


def geometry_text(dim: Column, rings: Column) -> Column:
    """GeoJSON of a part in metres: a point, a line or a polygon, in degrees of nine places."""

    def point(p: Column) -> Column:
        lon, lat = geometry.degrees(p["x"], p["y"])
        return F.concat(F.lit("["), F.format_string("%.9f,%.9f", lon, lat), F.lit("]"))

    line = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, point), ","), F.lit("]"))
    some = F.when(dim == 0, point(rings[0][0])).when(dim == 1, line(rings[0]))
    every = some.otherwise(F.concat(F.lit("["), F.array_join(F.transform(rings, line), ","), F.lit("]")))
    kind = F.when(dim == 0, "Point").when(dim == 1, "LineString").otherwise("Polygon")
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), every, F.lit("}"))


def feature_text(properties: Column, dim: Column, rings: Column) -> Column:
    """A GeoJSON feature; members of `properties` that are null are written as null. Ids keep their JSON type where
    the caller gives them as numbers or strings."""
    shape = F.when(rings.isNull(), F.lit("null")).otherwise(geometry_text(dim, rings))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit(',"geometry":'), shape, F.lit("}"))


def _documents(rows: DataFrame, path: str) -> None:
    """Rows scene_id, place, seq and line as one text file per scene."""
    placed = rows.repartition("scene_id").sortWithinPartitions("scene_id", "place", "seq")
    placed.select("scene_id", "line").write.partitionBy("scene_id").text(path)


def _around(scenes: DataFrame, head: Column, tail: Column) -> DataFrame:
    """Head and tail lines for each scene."""
    both = F.array(F.struct(F.lit(0).alias("place"), head.alias("line")), F.struct(F.lit(9).alias("place"), tail.alias("line")))
    return scenes.select("scene_id").distinct().select("scene_id", F.explode(both).alias("_b")).select("scene_id", "_b.place", F.lit(0).cast("long").alias("seq"), "_b.line")


def collections(features: DataFrame, path: str) -> None:
    """A FeatureCollection per scene from rows scene_id, seq and text."""
    last = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("seq"))) == 1
    body = features.withColumn("_last", last).select("scene_id", F.lit(1).alias("place"), F.col("seq").cast("long").alias("seq"), F.concat("text", F.when(F.col("_last"), "").otherwise(",")).alias("line"))
    _documents(body.union(_around(features, F.lit('{"type":"FeatureCollection","features":['), F.lit("]}"))), path)


def shown(notes: DataFrame, by: list[str]) -> DataFrame:
    """The notes that a report shows, with the number of each code: the first MOST_OF_CODE of a code, MOST in all."""
    nth = F.row_number().over(Window.partitionBy(*by, "code").orderBy("id"))
    first = notes.withColumn("_nth", nth).where(F.col("_nth") <= MOST_OF_CODE)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("code", "id"))
    first = first.withColumn("_place", place).where(F.col("_place") <= MOST)
    totals = notes.groupBy(*by, "code").agg(F.count("*").alias("total"))
    return first.drop("_nth", "_place").join(totals, [*by, "code"])


def reports(scenes: DataFrame, violations: DataFrame, variants: DataFrame, path: str) -> None:
    """A JSON report per scene: valid, the errors shown (see `shown`), and the variants by rank."""
    errors = shown(violations.withColumn("id", F.coalesce("id", F.lit(""))), ["scene_id"])
    errors = errors.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("code", "id", "variant_id", "said", "total"))).alias("errors"))
    ranked = variants.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in variants.columns if c not in ("scene_id", "rank")]))).alias("variants"))
    joined = scenes.select("scene_id").distinct().join(errors, "scene_id", "left").join(ranked, "scene_id", "left")
    empty = F.coalesce(F.size("errors"), F.lit(0)) <= 0
    body = F.to_json(F.struct(empty.alias("valid"), F.coalesce("errors", F.array()).alias("errors"), "variants"))
    _documents(joined.select("scene_id", F.lit(1).alias("place"), F.lit(0).cast("long").alias("seq"), body.alias("line")), path)


def spaced(amount: Column, digits: int = 2) -> Column:
    """A number for readers: groups of three by spaces, a decimal comma."""
    return F.translate(F.format_number(amount, digits), ",.", " ,")


def html(parts: DataFrame, variants: DataFrame, path: str) -> None:
    """An HTML report per scene without outside resources: a map as inline SVG and a table of the variants. parts
    has scene_id, id, dim, rings (metres) and style, a colour."""
    points = F.flatten("rings")
    edge = parts.select("scene_id", F.explode(points).alias("p")).groupBy("scene_id").agg(F.min("p.x").alias("x0"), F.max("p.y").alias("y1"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"))
    shape = lambda p: F.format_string("%.2f,%.2f", p["x"] - F.col("x0"), F.col("y1") - p["y"])
    path_of = F.array_join(F.transform("rings", lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, shape), " L"))), " ")
    safe = F.replace(F.replace(F.replace(F.col("id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    drawn = parts.where("dim > 0").join(edge, "scene_id").select("scene_id", F.lit(2).alias("place"), F.xxhash64("id").alias("seq"), F.concat(F.lit('<path fill="none" stroke="'), F.col("style"), F.lit('" d="'), path_of, F.lit('"><title>'), safe, F.lit("</title></path>")).alias("line"))
    box = edge.select("scene_id", F.lit(1).alias("place"), F.lit(0).cast("long").alias("seq"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %.2f %.2f">', F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("line"))
    close = edge.select("scene_id", F.lit(3).alias("place"), F.lit(0).cast("long").alias("seq"), F.lit("</svg><table>").alias("line"))
    row = F.concat(F.lit("<tr><td>"), F.col("rank").cast("string"), F.lit("</td><td>"), F.col("score").cast("string"), F.lit("</td><td>"), spaced(F.col("cost")), F.lit("</td><td>"), spaced(F.col("length")), F.lit("</td></tr>"))
    table = variants.select("scene_id", F.lit(4).alias("place"), F.col("rank").cast("long").alias("seq"), row.alias("line"))
    _documents(drawn.union(box).union(close).union(table).union(_around(parts, F.lit("<!DOCTYPE html><html><meta charset=utf-8><body>"), F.lit("</table></body></html>"))), path)


def snapshot(variants: DataFrame, path: str, round_: int) -> None:
    """The best variants so far, one folder per round: a run that is taken up again reads the last complete one."""
    variants.write.mode("overwrite").parquet(f"{path}/round={round_:06d}")


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last round of snapshots whose write has committed."""
    every = spark.read.parquet(path)
    return every.join(every.agg(F.max("round").alias("round")), "round").drop("round")


def tiles(parts: DataFrame, copies: int, pitch: float) -> DataFrame:
    """A map of any size: `copies` shifted copies of parts on square rings around the first, of which the nearest
    stays empty; ids get the number of their copy. Row counts grow in proportion, and nothing is shuffled."""
    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = parts.withColumn("_n", n)
    ring = F.when(F.col("_n") > 0, F.floor((F.sqrt((F.col("_n") + 8).cast("double")) + 1) / 2)).otherwise(0)  # from ring 2 on
    rows = rows.withColumn("_r", ring).withColumn("_k", F.col("_n") + 8 - (2 * F.col("_r") - 1) * (2 * F.col("_r") - 1))
    side, along = F.floor(F.col("_k") / (2 * F.col("_r"))), F.pmod(F.col("_k"), F.nullif(2 * F.col("_r"), F.lit(0))) - F.col("_r")
    r = F.col("_r")
    dx = F.when(r == 0, 0).when(side == 0, along).when(side == 1, r).when(side == 2, -along).otherwise(-r)
    dy = F.when(r == 0, 0).when(side == 0, -r).when(side == 1, along).when(side == 2, r).otherwise(-along)
    rows = rows.withColumns({"_dx": dx * pitch, "_dy": dy * pitch})
    moved = F.transform("rings", lambda q: F.transform(q, lambda p: F.struct((p["x"] + F.col("_dx")).alias("x"), (p["y"] + F.col("_dy")).alias("y"))))
    return rows.withColumns({"rings": moved, "id": F.when(F.col("_n") > 0, F.concat("id", F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col("id"))}).drop("_n", "_r", "_k", "_dx", "_dy")


def ellipses(spark: SparkSession, n: int, vertices: int = 1024, pitch: float = 30.0) -> DataFrame:
    """scene_id, id, part, dim and rings of n dense ellipses on a square grid."""
    row = spark.range(n).withColumnRenamed("id", "_k")
    side = max(1, round(n**0.5))
    cx, cy = (F.col("_k") % side) * pitch, F.floor(F.col("_k") / side) * pitch
    turn = lambda i: 2 * 3.141592653589793 * i / vertices
    ring = F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda i: F.struct((cx + pitch / 3 * F.cos(turn(i % vertices))).alias("x"), (cy + pitch / 4 * F.sin(turn(i % vertices))).alias("y")))
    return row.select(F.lit("ellipses").alias("scene_id"), F.concat(F.lit("e"), "_k").alias("id"), F.lit(0).alias("part"), F.lit(2).alias("dim"), F.array(ring).alias("rings"))
