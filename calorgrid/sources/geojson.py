"""Maps as GeoJSON, read into typed tables: objects, their parts in metres, and warnings as rows.

A document is a FeatureCollection per file (its name is the scene), or one feature per line, which Spark can split
and which has no size limit. Objects keep the JSON type of their ids. Nothing stops at a bad object: what makes a
scene unusable is a row of severity `error`, what was mended one of severity `warning`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from calorgrid.functions import catalog, geometry

# Types of objects, coordinate systems, kinds of lines, the dn of a restriction that states none.
TYPES = ("source", "heat_network", "heat_chamber", "oks_connection_point", "oks_future", "oks_existing", "restriction")
SYSTEMS = ("CRS84", "EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:EPSG::4326")
LINEAR = ("gas_pipeline", "power_cable", "heat_network")
ASSUMED_DN = 300
POINTS = ("source", "heat_chamber", "oks_connection_point")
FLAT, RINGS, POLYGONS = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


@dataclass
class Scenes:
    """objects: scene_id, id, id_text, id_type, object_type, kind, dn, flow and valid. parts: scene_id, id, part, dim
    (0 points, 1 lines, 2 polygons) and rings (arrays of x, y in metres). notes: scene_id, id, severity, code, said."""

    objects: DataFrame
    parts: DataFrame
    notes: DataFrame


def documents(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, seq and feature (a variant, null if it is none) of each feature of FeatureCollections, and a row
    without seq for each document that is none or names another coordinate system: code says why."""
    whole = spark.read.text(path, wholetext=True).select(_scene(), "value")
    root = F.from_json("value", "type string, features array<string>, crs struct<properties:struct<name:string>>")
    docs = whole.withColumn("d", root)
    system = F.col("d.crs.properties.name")
    code = F.when(F.col("d.features").isNull() | (F.coalesce("d.type", F.lit("")) != "FeatureCollection"), "INVALID_JSON")
    code = code.when(system.isNotNull() & ~system.isin(*SYSTEMS), "UNSUPPORTED_CRS")
    docs = docs.select("scene_id", F.coalesce(F.when(code.isNull(), F.col("d.features")), F.array().cast("array<string>")).alias("f"), code.alias("code"))
    rows = docs.select("scene_id", "code", F.posexplode_outer("f").alias("seq", "_text"))
    return rows.where("seq is not null or code is not null").select("scene_id", "seq", "code", F.try_parse_json("_text").alias("feature"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one feature per line; their order within a file is that of their ids."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(_scene(), F.try_parse_json("value").alias("feature"))
    return rows.select("scene_id", F.xxhash64(F.to_json("feature")).alias("seq"), F.lit(None).cast("string").alias("code"), "feature")


def _scene() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[a-z]+)*$", 1).alias("scene_id")


def value(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("feature", path, kind)


def plain_id(text: Column) -> Column:
    """An id without trailing zeros after its point."""
    return F.regexp_replace(F.regexp_replace(text, r"^(-?\d+\.\d*?)0+$", "$1"), r"\.$", "")



def _type_of(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("feature", path, "variant"))


def features(rows: DataFrame) -> DataFrame:
    """The members of features as columns; repeated ids of a scene get `~dup` and a number from the second on."""
    of_props, of_feature = _type_of("$.properties.id"), _type_of("$.id")
    own = F.col("_of_props").isNotNull() & (F.col("_of_props") != "VOID")
    f = rows.where("seq is not null").withColumns({"_of_props": of_props, "_of_feature": of_feature})
    raw = F.when(own, value("$.properties.id")).otherwise(value("$.id"))
    f = f.withColumns({"id_text": raw, "id_type": F.when(own, F.col("_of_props")).otherwise(F.col("_of_feature")), "at_feature": ~own})
    text = F.col("id_type") == "STRING"
    f = f.withColumn("first_id", F.when(text, F.when(F.trim("id_text") != "", F.col("id_text"))).otherwise(plain_id(F.col("id_text"))))
    nth = F.row_number().over(Window.partitionBy("scene_id", "first_id").orderBy("seq"))
    again = F.when(nth == 1, "").when(nth == 2, "~dup").otherwise(F.concat(F.lit("~dup"), nth - 1))
    props = {c: value(f"$.properties.{c}") for c in ("object_type", "restriction_type", "diameter", "flow_tph")}
    types = {f"{c}_type": _type_of(f"$.properties.{c}") for c in ("diameter", "flow_tph")}
    geometry_type = value("$.geometry.type")
    return f.withColumns({**props, **types, "id": F.concat("first_id", again), "geometry_type": geometry_type}).drop("_of_props", "_of_feature")


def _polygons(kind: Column, at: str) -> Column:
    """The coordinates of a geometry as polygons of rings, whatever its type."""
    get = lambda t: F.try_variant_get(at, "$.coordinates", t)
    line = F.array(F.array(get(FLAT)))
    found = F.when(kind == "Point", F.array(F.array(F.array(get("array<double>"))))).when(kind == "LineString", line)
    found = found.when(kind == "MultiPoint", F.transform(get(FLAT), lambda p: F.array(F.array(p))))
    found = found.when(kind == "MultiLineString", F.transform(get(RINGS), lambda r: F.array(r)))
    return found.when(kind == "Polygon", F.array(get(RINGS))).when(kind == "MultiPolygon", get(POLYGONS))


def _shapes(f: DataFrame) -> DataFrame:
    """scene_id, id, place, dim and rings (degrees) of each part; collections are opened up to three deep."""
    g = f.select("scene_id", "id", F.try_variant_get("feature", "$.geometry", "variant").alias("g"), F.lit("").alias("place"))
    out = None
    for deep in range(4):
        kind = F.try_variant_get("g", "$.type", "string")
        dim = F.when(kind.contains("Polygon"), 2).when(kind.contains("Line"), 1).otherwise(0)
        own = g.select("scene_id", "id", "place", dim.alias("dim"), F.posexplode(_polygons(kind, "g")).alias("_n", "rings"))
        own = own.withColumn("place", F.concat("place", F.format_string("%06d", "_n"))).drop("_n")
        out = own if out is None else out.union(own)
        if deep < 3:
            inner = F.posexplode(F.try_variant_get("g", "$.geometries", "array<variant>")).alias("_n", "_g")
            g = g.where(kind == "GeometryCollection").select("scene_id", "id", "place", inner)
            g = g.select("scene_id", "id", F.col("_g").alias("g"), F.concat("place", F.format_string("%06d.", "_n")).alias("place"))
    valid = F.forall("rings", lambda r: (F.size(r) > 0) & F.forall(r, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()))
    return out.where(F.col("rings").isNotNull() & valid)


def metres(rings: Column) -> Column:
    def point(p: Column) -> Column:
        east, north = geometry.utm(p[0], p[1])
        return F.struct(east.alias("x"), north.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))


def normalise(rows: DataFrame, unknown_restriction: str = "skip") -> Scenes:
    """Typed tables of the features that `documents` or `lines` gave.

    unknown_restriction says what becomes of restrictions of a kind that is not in the vocabulary: `skip` leaves
    them out, `forbid_1m` makes them prohibited sites, `error` marks the scene.
    """
    f = features(rows)
    typed = F.col("object_type").isin(*TYPES)
    said = F.coalesce("restriction_type", F.lit(""))
    known = catalog.kind_of(said)
    limited = F.col("object_type") == "restriction"
    other = F.lit("prohibited_site") if unknown_restriction == "forbid_1m" else F.lit(None).cast("string")
    kind = F.when(F.col("object_type") == "oks_existing", "building").when(limited, F.coalesce(known, other))
    flow, size = (F.trim(c).try_cast("decimal(18,6)") for c in ("flow_tph", "diameter"))
    piped = (F.col("object_type") == "heat_network") | (limited & (kind == "heat_network"))
    dn = F.when(size > 0, catalog.at_least_dn(size))
    dn = F.when(limited & (kind == "heat_network"), F.coalesce(dn, F.lit(ASSUMED_DN))).when(F.col("object_type").isin("heat_network", "heat_chamber"), dn)
    demand = F.col("object_type") == "oks_connection_point"
    f = f.withColumns({"kind": kind, "dn": dn, "flow": F.when(demand & (flow >= 0), flow), "_size": size})
    f = f.withColumn("valid", F.when(demand, F.col("flow").isNotNull()).otherwise(F.lit(True)))

    shapes = _shapes(f.where(typed).select("scene_id", "id", "feature")).join(f.select("scene_id", "id", "object_type", "kind"), ["scene_id", "id"])
    solid = F.col("kind") == "building"
    dropped = F.col("kind").isNotNull() & ((F.col("dim") == 0) | (solid & (F.col("dim") != 2)))
    outlined = F.col("kind").isin(*LINEAR) & (F.col("dim") == 2)
    shapes = shapes.withColumns({"dropped": F.coalesce(dropped, F.lit(False)), "outlined": F.coalesce(outlined, F.lit(False))})
    seen = shapes.groupBy("scene_id", "id").agg(F.count_if(~F.col("dropped")).alias("usable"), F.max("dropped").alias("dropped"), F.max("outlined").alias("outlined"), F.max("dim").alias("dim"), F.count("*").alias("n"))
    kept = shapes.where("not dropped")
    rings = F.explode(F.when(F.col("outlined"), F.transform("rings", lambda r: F.array(r))).otherwise(F.array("rings")))
    kept = kept.select("scene_id", "id", "place", F.when(F.col("outlined"), 1).otherwise(F.col("dim")).alias("dim"), rings.alias("rings"), "object_type")
    length = F.size("rings") > 0
    kept = kept.where((F.col("object_type") != "heat_network") | (F.size(F.array_distinct(F.col("rings")[0])) > 1)).where(length)
    part = F.row_number().over(Window.partitionBy("scene_id", "id").orderBy("place", F.xxhash64("rings"))) - 1
    parts = kept.withColumn("part", part).withColumn("rings", metres(F.col("rings")))
    # the lines of a network given as one object become objects of their own
    split = (F.col("object_type") == "heat_network") & (F.col("part") > 0)
    parts = parts.withColumn("of", F.col("id")).withColumn("id", F.when(split, F.concat("id", F.lit("~part"), "part")).otherwise(F.col("id")))
    parts = parts.withColumn("part", F.when(F.col("object_type") == "heat_network", 0).otherwise(F.col("part")))

    f = f.join(seen, ["scene_id", "id"], "left")
    point, area = F.col("object_type").isin(*POINTS), F.col("object_type").isin("oks_future", "oks_existing")
    pipe = F.col("object_type") == "heat_network"
    shaped = F.coalesce(F.when(point, F.col("geometry_type") == "Point").when(pipe, F.col("geometry_type").isin("LineString", "MultiLineString")).when(area, F.col("dim") == 2), F.lit(True))
    shaped = shaped & (F.coalesce("usable", F.lit(0)) > 0)
    whole = lambda c: F.col(c).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    bad = lambda code, when, say=F.lit(None).cast("string"), severity="warning": F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), say.cast("string").alias("said")))
    usable = typed & (~limited | F.col("kind").isNotNull())
    notes = F.array_compact(F.array(
        bad("INVALID_ATTRIBUTE", F.col("id").isNull(), F.col("id_text"), "error"),
        bad("FEATURE_LEVEL_ID", F.col("at_feature") & F.col("id").isNotNull()),
        bad("UNSUPPORTED_OBJECT_TYPE", ~F.coalesce(typed, F.lit(False)), F.col("object_type")),
        bad("DUPLICATE_ID", F.col("id") != F.col("first_id"), F.col("first_id")),
        bad("RESTRICTION_TYPE_NORMALIZED", limited & known.isNotNull() & (said != F.lower(F.trim(said))), said),
        bad("UNSUPPORTED_RESTRICTION", limited & known.isNull(), said, "error" if unknown_restriction == "error" else "warning"),
        bad("RESTRICTION_HEAT_NETWORK", limited & (F.col("kind") == "heat_network")),
        bad("DN_ASSUMED", limited & (F.col("kind") == "heat_network") & ~F.coalesce(F.col("_size") > 0, F.lit(False)), F.col("diameter")),
        bad("DN_MISSING", pipe & ~F.coalesce(F.col("_size") > 0, F.lit(False)), F.col("diameter")),
        bad("DN_NORMALIZED", piped & F.coalesce(F.col("_size") > 0, F.lit(False)) & ((F.col("_size") != F.col("dn")) | ~whole("diameter_type")), F.col("diameter")),
        bad("INVALID_FLOW", demand & ~F.col("valid"), F.col("flow_tph")),
        bad("FLOW_PARSED", demand & F.col("valid") & (F.col("flow_tph_type") == "STRING"), F.col("flow_tph")),
        bad("MULTILINE_NETWORK_SPLIT", pipe & (F.col("geometry_type") == "MultiLineString"), F.col("usable")),
        bad("GEOMETRY_COLLECTION", F.col("kind").isNotNull() & (F.col("geometry_type") == "GeometryCollection"), F.col("n")),
        bad("GEOMETRY_PART_DROPPED", F.col("dropped") & usable),
        bad("LINEAR_RESTRICTION_POLYGON", F.col("outlined") & usable),
        bad("RESTRICTION_SKIPPED", F.col("kind").isNotNull() & (F.coalesce("usable", F.lit(0)) == 0)),
        bad("INVALID_GEOMETRY", usable & ~shaped & F.col("kind").isNull() & F.col("id").isNotNull(), F.col("geometry_type"), "error"),
    ))
    said_rows = f.select("scene_id", "id", F.explode(notes).alias("n")).select("scene_id", "id", "n.*")
    broken = rows.where("code is not null").select("scene_id", F.lit(None).cast("string").alias("id"), F.lit("error").alias("severity"), "code", F.lit(None).cast("string").alias("said"))
    kept_objects = f.where(usable & shaped & F.col("id").isNotNull())
    named = parts.select("scene_id", F.col("of").alias("_of"), F.col("id").alias("_id")).distinct()
    objects = kept_objects.join(named, (named["_of"] == kept_objects["id"]) & (named["scene_id"] == kept_objects["scene_id"])).select(kept_objects["scene_id"], F.col("_id").alias("id"), "id_text", "id_type", "object_type", "kind", "dn", "flow", "valid")
    parts = parts.join(objects.select("scene_id", "id"), ["scene_id", "id"], "left_semi").select("scene_id", "id", "part", "dim", "rings")
    return Scenes(objects, parts, said_rows.union(broken))


def segments(parts: DataFrame) -> DataFrame:
    """scene_id, id, part, ring, seq, x1, y1, x2, y2: the sides of rings and lines, however many they have."""
    rows = parts.select("scene_id", "id", "part", F.posexplode("rings").alias("ring", "_r"))
    side = F.transform(F.sequence(F.lit(1), F.size("_r") - 1), lambda i: F.struct(F.get("_r", i - 1).alias("a"), F.get("_r", i).alias("b")))
    rows = rows.where(F.size("_r") > 1).select("scene_id", "id", "part", "ring", F.posexplode(side).alias("seq", "_s"))
    return rows.select("scene_id", "id", "part", "ring", "seq", F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))


def fingerprint(rings: Column, digits: int = 6) -> Column:
    """A hash of a line or of rings that does not depend on the direction in which they are given."""
    def text(r: Column) -> Column:
        points = F.transform(r, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"].cast("double"), p["y"].cast("double")))
        return F.least(F.array_join(points, ","), F.array_join(F.reverse(points), ","))

    return F.sha2(F.array_join(F.array_sort(F.transform(rings, text)), ";"), 256)
