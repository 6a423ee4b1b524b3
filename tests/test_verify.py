"""Verification: a sound result has no violation; each planted fault is found under its code."""

import copy
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from calorgrid.functions import geometry, pricing
from calorgrid.operators import verify
from calorgrid.sources import geojson

ORIGIN = (414000.0, 6173000.0)


@pytest.fixture(scope="module")
def places(spark):
    """Metres around the origin -> degrees, and the metres that these are read as."""
    points = [(x, y) for x in (-50, -20, -10, 0, 3, 10, 30, 50, 60) for y in (-10, 0, 2, 10, 30, 50, 60, 100, 110)]
    rows = spark.createDataFrame([(float(x), float(y), ORIGIN[0] + x, ORIGIN[1] + y) for x, y in points], "px double, py double, x double, y double")
    lon, lat = geometry.degrees(F.col("x"), F.col("y"))
    rows = rows.select("px", "py", lon.alias("lon"), lat.alias("lat"))
    east, north = geometry.utm(F.col("lon"), F.col("lat"))
    return {(int(r[0]), int(r[1])): ([r[2], r[3]], (r[4], r[5])) for r in rows.select("*", east, north).collect()}


def feature(kind, coordinates, **props):
    return {"type": "Feature", "properties": props, "geometry": kind and {"type": kind, "coordinates": coordinates}}


def plan(places):
    """A map: two pipes that meet in a chamber, a consumer. And its sound result: one pipe of DN80."""
    at = lambda *p: [places[q][0] for q in p]
    given = [
        feature("Point", at((-50, 0))[0], id="s", object_type="source"),
        feature("LineString", at((-50, 0), (0, 0)), id="p1", object_type="heat_network", diameter=150),
        feature("LineString", at((0, 0), (50, 0)), id="p2", object_type="heat_network", diameter=150),
        feature("Point", at((0, 0))[0], id=5, object_type="heat_chamber"),
        feature("Point", at((0, 100))[0], id="d", object_type="oks_connection_point", flow_tph=10),
    ]
    return given, [line(places, "l1", 5, "d", [(0, 0), (0, 100)]), summary("v1", 1, places, ties=1)]


def line(places, id_, start, end, way, dn=80, price=83530, flow=10, variant="v1", **more):
    m = [places[p][1] for p in way]
    length = round(sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(m, m[1:])), 9)
    props = {"id": id_, "object_type": "heat_network", "variant_id": variant, "start_node_id": start, "end_node_id": end, "flow_tph": flow, "diameter": dn, "length": length, "laying_method": "base", "depth_start": None, "depth_end": None, "cost": float(round(Decimal(str(length)) * price, 2))}
    return feature("LineString", [places[p][0] for p in way], **props | more)


def summary(variant, rank, places, ties=1, lines=None, penalty=0, chambers=0, missing=()):
    lines = lines or [line(places, "x", 5, "d", [(0, 0), (0, 100)])]
    pipes = sum(Decimal(str(x["properties"]["cost"])) for x in lines)
    length = sum(Decimal(str(x["properties"]["length"])) for x in lines)
    cost = pipes + chambers + 5_000_000 * ties + penalty
    score = round(cost * Decimal("0.000000028") + length * Decimal("0.003"), 12)
    return feature(None, None, id=f"sum_{variant}", object_type="variant_summary", variant_id=variant, rank=rank, construction_cost=float(cost - penalty), chamber_construction_cost=chambers, existing_chamber_tie_in_count=ties, existing_chamber_tie_in_cost=5_000_000 * ties, unconnected_penalty=penalty, calculated_cost=float(cost), new_network_length=float(length), score=float(score), unconnected_oks_ids=list(missing))


def chamber(places, id_, at, dn=150, cost=3_000_000):
    return feature("Point", places[at][0], id=id_, object_type="heat_chamber", variant_id="v1", diameter=dn, cost=cost)


def technical(places, id_, at):
    return feature("Point", places[at][0], id=id_, object_type="technical_node", variant_id="v1")


def changed(of, index=0, **props):
    of[index]["properties"].update(props)
    return of


def faults(places):
    """name -> (code, result, more objects of the map)."""
    good = lambda: copy.deepcopy(plan(places)[1])
    box = lambda *c: [[places[p][0] for p in c]]
    ways = [(0, 0), (0, 50)], [(0, 50), (0, 100)]
    two = [line(places, "l1", 5, "t", ways[0]), line(places, "l2", "t", "d", ways[1]), technical(places, "t", (0, 50))]
    deep = lambda *h: [line(places, "l1", 5, "t", ways[0], depth_start=h[0], depth_end=h[1]), line(places, "l2", "t", "d", ways[1], depth_start=h[2], depth_end=h[3]), technical(places, "t", (0, 50)), summary("v1", 1, places)]
    near = feature("Polygon", box((3, 50), (10, 50), (10, 60), (3, 60), (3, 50)), id="b", object_type="restriction", restriction_type="oks")
    wire = feature("LineString", [places[p][0] for p in ((-10, 50), (10, 50))], id="w", object_type="restriction", restriction_type="metro")
    road = feature("LineString", [places[p][0] for p in ((-10, 10), (10, 60))], id="r", object_type="restriction", restriction_type="road")
    beside = feature("LineString", [places[p][0] for p in ((0, 30), (3, 60))], id="k", object_type="restriction", restriction_type="power_cable")
    return {
        "sound": (None, good(), []),
        "sound in two pieces": (None, [*two, summary("v1", 1, places, lines=two[:2])], []),
        "unconnected": (None, [feature(None, None, **summary("v1", 1, places, ties=0, lines=[line(places, "x", 5, "d", [(0, 0), (0, 0)])], penalty=105_000_000, missing=["d"])["properties"] | {"new_network_length": 0})], []),
        "id of the map": ("DUPLICATE_ID", changed(good(), id="p1"), []),
        "four variants": ("VARIANT_COUNT", [*good(), *[summary(f"v{k}", k, places) for k in (2, 3, 4)]], []),
        "no summary": ("SUMMARY_COUNT", good()[:1], []),
        "twice the same": ("DUPLICATE_VARIANT", [*good(), line(places, "l9", 5, "d", [(0, 0), (0, 100)], variant="v2"), summary("v2", 2, places)], []),
        "no such node": ("DANGLING_REFERENCE", changed(good(), start_node_id="nowhere"), []),
        "end elsewhere": ("ENDPOINT", [line(places, "l1", 5, "d", [(0, 0), (0, 110)]), good()[1]], []),
        "number as text": ("REFERENCE_ID_TYPE", changed(good(), start_node_id="5"), []),
        "length": ("VALUE_MISMATCH", changed(good(), length=99), []),
        "flow": ("VALUE_MISMATCH", changed(good(), flow_tph=11), []),
        "cost": ("VALUE_MISMATCH", changed(good(), cost=1.0), []),
        "score": ("VALUE_MISMATCH", changed(good(), 1, score=1.0), []),
        "no pipe": ("INVALID_ATTRIBUTE", changed(good(), diameter=81), []),
        "too wide": ("DIAMETER", changed(good(), diameter=100), []),
        "one depth": ("DEPTH", changed(good(), depth_start=3.0), []),
        "back and forth": ("TURN_ANGLE", [line(places, "l1", 5, "d", [(0, 0), (30, 60), (-20, 30), (0, 100)]), good()[1]], []),
        "cycle": ("NEW_CYCLE", [*good(), line(places, "l2", 5, "d", [(0, 0), (30, 60), (0, 100)])], []),
        "loose": ("ORPHAN_EDGE", [*good(), line(places, "l2", "a", "b", [(30, 30), (60, 60)]), technical(places, "a", (30, 30)), technical(places, "b", (60, 60))], []),
        "two roots": ("MULTIPLE_ROOTS", [*good(), line(places, "l2", "n", "d", [(50, 0), (0, 100)]), chamber(places, "n", (50, 0))], []),
        "rank": ("RANK", changed(good(), 1, rank=2), []),
        "said missing": ("UNCONNECTED_IDS", changed(good(), 1, unconnected_oks_ids=["d"]), []),
        "technical end": ("TECHNICAL_BRANCH", [*good(), line(places, "l2", 5, "t", [(0, 0), (30, 30)]), technical(places, "t", (30, 30))], []),
        "chamber of two": ("CHAMBER_DEGREE", [two[0], two[1], chamber(places, "t", (0, 50), 80), good()[1]], []),
        "chamber too small": ("CHAMBER_DN", [line(places, "l1", "n", "d", [(30, 0), (0, 100)]), chamber(places, "n", (30, 0), 100), good()[1]], []),
        "chamber near": ("NEARBY_CHAMBER", [line(places, "l1", "n", "d", [(3, 0), (0, 100)]), chamber(places, "n", (3, 0)), good()[1]], []),
        "many rays": ("NODE_DEGREE", [*good(), *[line(places, f"m{k}", 5, f"t{k}", [(0, 0), p]) for k, p in enumerate([(30, 30), (50, 50), (60, 30)])]], []),
        "school": ("CLEARANCE", good(), [near]),
        "metro": ("CLEARANCE", good(), [wire]),
        "flat road": ("CROSSING_ANGLE", good(), [road]),
        "beside a cable": ("SPECIAL_CORRIDOR", good(), [beside]),
        "crosses another": ("NEW_INTERSECTION", [*good(), line(places, "l2", "a", "b", [(-20, 30), (30, 60)])], []),
        "crosses itself": ("SELF_INTERSECTION", [line(places, "l1", 5, "d", [(0, 0), (0, 60), (30, 60), (-20, 30), (-20, 50), (0, 100)]), good()[1]], []),
        "too close": ("NEW_GABARIT_OVERLAP", [line(places, "l1", 5, "d", [(0, 0), (0, 100)], dn=1400), line(places, "l2", "a", "b", [(3, 10), (3, 60)], dn=1400), good()[1]], []),
        "shallow": ("DEPTH_COVER", deep(0.5, 1, 1, 1), []),
        "steep": ("DEPTH_SLOPE", deep(1, 9, 9, 9), []),
        "through 3 m": ("DEPTH_SPLIT", deep(2, 4, 4, 4), []),
        "a step": ("DEPTH_CONTINUITY", deep(1, 1, 2, 2), []),
    }


def test_every_fault_is_found(spark, places, tmp_path):
    given, _ = plan(places)
    cases = faults(places)
    for folder in ("maps", "results"):
        (tmp_path / folder).mkdir()
    for k, (name, (_, result, more)) in enumerate(cases.items()):
        write = lambda folder, features, k=k: (tmp_path / folder / f"c{k:02}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        write("maps", given + more), write("results", result)
    scenes = geojson.normalise(geojson.documents(spark, str(tmp_path / "maps")))
    result = verify.result(geojson.documents(spark, str(tmp_path / "results")))
    got = {}
    for r in verify.verify(scenes, result).collect():
        got.setdefault(list(cases)[int(r["scene_id"][1:])], set()).add((r["code"], r["id"], r["said"]))
    for name, (code, _, _) in cases.items():
        codes = {c for c, _, _ in got.get(name, set())}
        if code is None:
            assert not got.get(name), (name, got[name])
        else:
            assert code in codes, (name, got.get(name))
    assert {"VALUE_MISMATCH"} == {c for c, _, _ in got["length"] | got["flow"]}
    assert {c for c, _, _ in got["too wide"]} <= {"DIAMETER", "VALUE_MISMATCH"}


def _lines(spark, rows):
    """id, dn, start, end and the corners of lines of one variant."""
    lines = spark.createDataFrame(rows, "id string, dn int, start string, end string, points array<struct<x double, y double>>")
    return lines.withColumns({"scene_id": F.lit("s"), "variant_id": F.lit("v")})


def _codes(lines):
    return sorted((r["code"], r["id"], r["said"]) for found in verify.intersections(lines) for r in found.collect())


def test_star_forms_no_pairs(spark, monkeypatch):
    """Pipes around one node are no pairs, however near each other; what crosses them still is found, and so are pipes
    that end at one point under two names, and the widest pipes at their full width."""
    formed = []
    gap2 = geometry.gap2
    monkeypatch.setattr(geometry, "gap2", lambda *quad: formed.append(1) or gap2(*quad))
    written = []
    cut = verify.cut
    monkeypatch.setattr(verify, "cut", lambda df, *a: written.append(cut(df, *a)) or written[-1])
    star = [(f"l{i:03}", 80, "hub", f"e{i}", [(0.0, 0.0), (300.0 * (i % 7 - 3), 1000.0 + i)]) for i in range(200)]
    assert _codes(_lines(spark, star)) == [] and formed
    assert written[-1].count() == 0  # before, 19,900 pairs
    other = [("x", 80, "p", "q", [(-2000.0, 500.0), (2000.0, 500.0)]), ("y", 80, "other", "z", [(0.0, 0.0), (0.0, -40.0)])]
    got = _codes(_lines(spark, star + other))
    assert [g for g in got if g[0] == "NEW_INTERSECTION"] == [("NEW_INTERSECTION", f"l{i:03}", "x") for i in range(200)]
    assert {g[1:] for g in got if g[0] == "NEW_GABARIT_OVERLAP"} == {(f"l{i:03}", "y") for i in range(200)}
    wide = [("a", 1400, "1", "2", [(0.0, 0.0), (50.0, 0.0)]), ("b", 1400, "3", "4", [(0.0, 3.3), (50.0, 3.3)])]
    assert _codes(_lines(spark, wide)) == [("NEW_GABARIT_OVERLAP", "a", "b")]
    bent = [("c", 80, "1", "2", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (20.0, -20.0)]), ("d", 80, "3", "4", [(0.0, 300.0), (99.0, 300.0)])]
    assert _codes(_lines(spark, bent)) == [("SELF_INTERSECTION", "c", "")]


def test_found_rows_are_written(spark, sf_dir):
    """The rows of the rules come from written tables; as one plan of all rules they took the driver's memory."""
    from calorgrid.plans import audits

    plan = verify.verify(*audits.stand_in(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") < 20


def test_sums_of_long_networks(spark, sf_dir):
    """Lengths that together pass 10^9 m, which a length of one line can't; before, their sum was an error."""
    from calorgrid.plans import audits

    scenes, r = audits.stand_in(spark, sf_dir)
    r.lines = r.lines.withColumn("length", F.lit("900000000").cast("decimal(18,9)"))
    n = {x["scene_id"]: x["count"] for x in r.lines.groupBy("scene_id").count().collect()}
    told = verify.verify(scenes, r).where("code = 'VALUE_MISMATCH' and id = 'sum' and said like 'new_network_length%'").collect()
    assert {x["scene_id"]: Decimal(x["said"].split()[1]) for x in told}["n0"] == 900_000_000 * n["n0"] > 10**9
    cost, length = F.lit("200000000000000000").cast("decimal(24,2)"), F.lit("600000000000").cast("decimal(28,9)")
    assert spark.range(1).select(pricing.score(cost, length)).first()[0] == 5_600_000_000 + 1_800_000_000
