"""Maps from GeoJSON files: defects become notes, good objects stay."""

import json

import pytest
from pyspark.sql import functions as F

from calorgrid.functions import geometry
from calorgrid.sources import config, geojson, write

LON, LAT = 37.6, 55.7


def feature(object_type, kind, coordinates, **props):
    return {"type": "Feature", "properties": {"object_type": object_type, **props}, "geometry": {"type": kind, "coordinates": coordinates}}


def at(x, y):
    return [LON + x / 1e5, LAT + y / 1e5]


def box(x, y, r=10):
    return [[at(x - r, y - r), at(x + r, y - r), at(x + r, y + r), at(x - r, y + r), at(x - r, y - r)]]


def restriction(kind, shape="Polygon", coordinates=None, **props):
    return feature("restriction", shape, coordinates or box(50, 50), restriction_type=kind, **props)


CASES = {
    "good": [feature("source", "Point", at(0, 0), id="s"), feature("heat_network", "LineString", [at(0, 0), at(90, 0)], id=7, diameter=150), feature("oks_connection_point", "Point", at(50, 90), id="d", flow_tph=10)],
    "ids": [feature("source", "Point", at(0, 0), id=1), feature("source", "Point", at(9, 0), id="1"), feature("source", "Point", at(0, 9), id=1.50), feature("source", "Point", at(0, 9), id="")],
    "flows": [feature("oks_connection_point", "Point", at(k, 0), id=f"d{k}", **p) for k, p in enumerate([{"flow_tph": "10"}, {"flow_tph": "abc"}, {}, {"flow_tph": -1}, {"flow_tph": 2.5}])],
    "dn": [feature("heat_network", "LineString", [at(0, k), at(9, k)], id=f"n{k}", **p) for k, p in enumerate([{"diameter": 350}, {"diameter": "400"}, {"diameter": 400.0}, {"diameter": 2000}, {"diameter": "n/a"}, {}])],
    "kinds": [restriction(k, id=f"r{i}") for i, k in enumerate([" School", "fence", "", "road"])],
    "lines": [restriction("gas_pipeline", id="g"), restriction("heat_network", id="h", diameter="x"), restriction("building", "LineString", [at(0, 0), at(9, 9)], id="b")],
    "split": [feature("heat_network", "MultiLineString", [[at(0, 0), at(9, 0)], [at(3, 3), at(3, 3)], [at(20, 0), at(30, 0)]], id="m", diameter=100)],
    "mixed": [{"type": "Feature", "id": "up", "properties": {"object_type": "restriction", "restriction_type": "park"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": at(0, 0)}, {"type": "Polygon", "coordinates": box(5, 5)}, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": box(90, 5)}]}]}}],
    "bad": [feature("source", "LineString", [at(0, 0), at(1, 1)], id="p"), feature("tower", "Point", at(0, 0), id="t"), {"type": "Feature", "properties": {"object_type": "oks_future", "id": "f"}, "geometry": None}],
}
CODES = {
    "good": {},
    "ids": {"DUPLICATE_ID": 1, "INVALID_ATTRIBUTE": 1},
    "flows": {"FLOW_PARSED": 1, "INVALID_FLOW": 3},
    "dn": {"DN_NORMALIZED": 4, "DN_MISSING": 2},
    "kinds": {"RESTRICTION_TYPE_NORMALIZED": 1, "UNSUPPORTED_RESTRICTION": 2},
    "lines": {"LINEAR_RESTRICTION_POLYGON": 2, "RESTRICTION_HEAT_NETWORK": 1, "DN_ASSUMED": 1, "GEOMETRY_PART_DROPPED": 1, "RESTRICTION_SKIPPED": 1},
    "split": {"MULTILINE_NETWORK_SPLIT": 1},
    "mixed": {"GEOMETRY_COLLECTION": 1, "GEOMETRY_PART_DROPPED": 1, "FEATURE_LEVEL_ID": 1},
    "bad": {"INVALID_GEOMETRY": 2, "UNSUPPORTED_OBJECT_TYPE": 1},
    "crs": {"UNSUPPORTED_CRS": 1},
    "text": {"INVALID_JSON": 1},
}


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("maps")
    for name, features in CASES.items():
        (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (folder / "crs.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:3857"}}, "features": CASES["good"]}))
    (folder / "text.geojson").write_text("no map")
    found = geojson.normalise(geojson.documents(spark, str(folder)))
    return geojson.Scenes(*[t.persist() for t in (found.objects, found.parts, found.notes)])


def test_notes(scenes):
    got = {name: {} for name in CODES}
    for r in scenes.notes.groupBy("scene_id", "code").count().collect():
        got[r["scene_id"]][r["code"]] = r["count"]
    assert got == CODES


def test_objects(scenes):
    rows = {(r["scene_id"], r["id"]): r for r in scenes.objects.collect()}
    ids = sorted(k for s, k in rows if s == "ids")
    assert ids == ["1", "1.5", "1~dup"] and {rows["ids", "1"]["id_type"], rows["ids", "1~dup"]["id_type"]} == {"BIGINT", "STRING"}
    assert [(rows["flows", f"d{k}"]["flow"], rows["flows", f"d{k}"]["valid"]) for k in range(5)] == [(10, True), (None, False), (None, False), (None, False), (pytest.approx(2.5), True)]
    assert [rows["dn", f"n{k}"]["dn"] for k in range(6)] == [400, 400, 400, 1400, None, None]
    assert {k: rows["kinds", k]["kind"] for s, k in rows if s == "kinds"} == {"r0": "social_area", "r3": "road"}
    assert rows["lines", "h"]["dn"] == 300 and ("lines", "b") not in rows
    assert sorted(k for s, k in rows if s == "split") == ["m", "m~part1"]
    assert not any(s in ("crs", "text", "bad") for s, _ in rows)


def test_parts_and_segments(scenes):
    parts = {(r["scene_id"], r["id"], r["part"]): r for r in scenes.parts.collect()}
    assert parts["lines", "g", 0]["dim"] == 1 and len(parts["lines", "g", 0]["rings"][0]) == 5
    assert ("mixed", "up", 1) in parts and ("mixed", "up", 2) not in parts
    p = parts["good", "s", 0]["rings"][0][0]
    assert 300_000 < p["x"] < 500_000 and 6_000_000 < p["y"] < 6_300_000
    sides = geojson.segments(scenes.parts).groupBy("scene_id", "id").count().collect()
    assert {(r["scene_id"], r["id"]): r["count"] for r in sides}["lines", "h"] == 4


def test_policies(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": CASES["kinds"]}))
    rows = geojson.documents(spark, str(tmp_path))
    forbidden = geojson.normalise(rows, "forbid_1m").objects
    assert forbidden.where("kind = 'prohibited_site'").count() == 2
    assert geojson.normalise(rows, "error").notes.where("severity = 'error'").count() == 2


def test_features_by_line(spark, scenes, tmp_path):
    (tmp_path / "good.geojsonl").write_text("\n".join(json.dumps(f) for f in CASES["good"]))
    got = geojson.normalise(geojson.lines(spark, str(tmp_path)))
    assert sorted(map(tuple, got.objects.collect()), key=repr) == sorted(map(tuple, scenes.objects.where("scene_id = 'good'").collect()), key=repr)
    assert got.notes.count() == 0


def test_writes_what_it_reads(spark, scenes, tmp_path):
    """Objects written as GeoJSON are read as the same objects and shapes, ids with their JSON types."""
    rows = scenes.objects.join(scenes.parts, ["scene_id", "id"]).where("scene_id in ('good', 'ids')")
    props = F.struct(F.col("id_text").alias("id"), "object_type", F.col("dn").alias("diameter"), F.col("flow").alias("flow_tph"))
    text = write.feature_text(props, F.col("dim"), F.col("rings"))
    write.collections(rows.select("scene_id", F.xxhash64("id").alias("seq"), text.alias("text")), str(tmp_path / "out"))
    for name in ("good", "ids"):
        (file,) = (tmp_path / "out" / f"scene_id={name}").glob("*.txt")
        got = json.loads(file.read_text())
        assert got["type"] == "FeatureCollection" and len(got["features"]) == 3
        for f in got["features"]:
            shape = f["geometry"]["coordinates"]
            for a in [shape] if f["geometry"]["type"] == "Point" else shape:
                assert any(abs(a[0] - b[0]) < 1e-8 and abs(a[1] - b[1]) < 1e-8 for c in CASES[name] for b in ([c["geometry"]["coordinates"]] if c["geometry"]["type"] == "Point" else c["geometry"]["coordinates"]))


def test_reports(spark, scenes, tmp_path):
    variants = spark.createDataFrame([("good", 1, 12.5, 1234567.891, 10.0)], "scene_id string, rank int, score double, cost double, length double")
    notes = scenes.notes.select("scene_id", "id", "code", "said", F.lit("v1").alias("variant_id"))
    write.reports(scenes.objects.where("scene_id in ('good', 'flows')"), notes, variants, str(tmp_path / "json"))
    read = {n: json.loads(next((tmp_path / "json" / f"scene_id={n}").glob("*.txt")).read_text()) for n in ("good", "flows")}
    assert read["good"]["valid"] and read["good"]["variants"][0]["rank"] == 1
    assert not read["flows"]["valid"] and {e["code"]: e["total"] for e in read["flows"]["errors"]} == {"FLOW_PARSED": 1, "INVALID_FLOW": 3}
    write.html(scenes.parts.where("scene_id = 'good'").withColumn("style", F.lit("red")), variants, str(tmp_path / "html"))
    page = next((tmp_path / "html" / "scene_id=good").glob("*.txt")).read_text()
    assert page.startswith("<!DOCTYPE html>") and page.count("<path") == 1 and "1 234 567,89" in page and page.rstrip().endswith("</html>")


def test_store_and_lookup(spark, scenes, tmp_path):
    config.write_parts(scenes.parts, str(tmp_path / "parts"))
    stored = spark.read.parquet(str(tmp_path / "parts"))
    b = stored.where("id = 'r0'").first()
    assert {r["id"] for r in config.window(stored, "kinds", b["min_x"] - 1, b["min_y"] - 1, b["max_x"] + 1, b["max_y"] + 1).collect()} == {"r0", "r3"}
    assert config.window(stored, "kinds", b["max_x"] + 1, 0, b["max_x"] + 2, 1e9).count() == 0
    wanted = spark.createDataFrame([("good", "7"), ("good", "x")], "scene_id string, id string")
    assert [r["object_type"] for r in config.by_id(scenes.objects, wanted).collect()] == ["heat_network"]


def test_tiles_and_snapshots(spark, scenes, tmp_path):
    one = scenes.parts.where("id = 's'")
    p = one.first()["rings"][0][0]
    places = {(round((r["rings"][0][0]["x"] - p["x"]) / 100), round((r["rings"][0][0]["y"] - p["y"]) / 100)) for r in write.tiles(one, 41, 100.0).collect()}
    ring2 = {(x, y) for x in range(-2, 3) for y in range(-2, 3) if max(abs(x), abs(y)) == 2}
    ring3 = {(x, y) for x in range(-3, 4) for y in range(-3, 4) if max(abs(x), abs(y)) == 3}
    assert len(places) == 41 and places == {(0, 0)} | ring2 | ring3
    assert write.ellipses(spark, 4, 16).selectExpr("size(rings[0])").first()[0] == 17
    for k in (1, 2):
        write.snapshot(spark.range(k), str(tmp_path / "s"), k)
    assert write.last_snapshot(spark, str(tmp_path / "s")).count() == 2


def test_rules_and_catalogue(spark, tmp_path):
    got = config.rules("geometry:\n  chamber_radius_m: 12\ninput:\n  unknown_restriction: forbid_1m\n")
    assert got["geometry.chamber_radius_m"] == 12 and got["input.unknown_restriction"] == "forbid_1m" and got["depth.slope"] == 0.1
    for wrong in ("geometry: {radius: 1}", "depth: {slope: steep}"):
        with pytest.raises(ValueError):
            config.rules(wrong)
    from calorgrid.functions import catalog

    (tmp_path / "c.csv").write_text("\n".join([",".join(catalog.COLUMNS), *(",".join(map(str, p)) for p in catalog.PIPES)]))
    assert [tuple(map(str, r)) for r in config.read_catalog(spark, str(tmp_path / "c.csv")).select("dn", "new_price").orderBy("dn").collect()] == [(str(p[0]), f"{p[3]}.00") for p in catalog.PIPES]


def test_fingerprint(spark):
    rows = spark.sql("SELECT array(array(struct(1D AS x, 2D AS y), struct(3D AS x, 4D AS y))) AS rings")
    turned = rows.select(F.transform("rings", lambda r: F.reverse(r)).alias("rings"))
    a, b = (t.select(geojson.fingerprint(F.col("rings"))).first()[0] for t in (rows, turned))
    assert a == b and len(a) == 64
    assert geometry.AXIS == 6378137.0
