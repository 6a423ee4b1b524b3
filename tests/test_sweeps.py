"""Sweeps over wide bins against plain loops: stretches, edges at stations, loads, and what they shuffle."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

import calorgrid.plans  # noqa: F401
from calorgrid.operators import intervals, network, spatial
from calorgrid.queries import QUERIES


def shuffles(capsys, df) -> int:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


def test_interval_sum(spark, monkeypatch):
    """Stretches within one bin, over several and over bins without an end; several lines."""
    monkeypatch.setattr(intervals, "WIDE", 50)
    rng = random.Random(3)
    zones = [(f"l{k % 3}", a := rng.choice([-120, 0, 49, 50, 51, rng.randrange(900)]), a + rng.choice([1, 7, 400]), Decimal(rng.randrange(1, 900)) / 100) for k in range(90)]
    got = intervals.interval_sum(spark.createDataFrame(zones, "line string, a long, b long, v decimal(12,2)"), "v").collect()
    want = set()
    for line in {z[0] for z in zones}:
        ends = sorted({x for z in zones if z[0] == line for x in z[1:3]})
        for a, b in zip(ends, ends[1:]):
            over = [z[3] for z in zones if z[0] == line and z[1] <= a and z[2] >= b]
            want |= {(line, a, b, sum(over))} if over else set()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_edges_at_across_bins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "WIDE", 50)
    lines, marks = [("x", 400.0), ("y", 20.0)], [("x", 10.0, "m1"), ("x", 10.0, "m2"), ("x", 60.5, "m3"), ("x", 399.0, None), ("x", 401.0, "m4"), ("z", 1.0, "m5")]
    got = network.edges_at(spark.createDataFrame(lines, "line string, length double"), spark.createDataFrame(marks, "line string, s double, node string"))
    names = {0.0: "x@0.0", 10.0: "m2", 60.5: "m3", 399.0: "x@399.0", 400.0: "x@400.0"}
    at = list(names)
    want = {("x", a, b, names[a], names[b]) for a, b in zip(at, at[1:])} | {("y", 0.0, 20.0, "y@0.0", "y@20.0")}
    assert {tuple(r) for r in got.collect()} == want


def test_edge_of(spark, monkeypatch):
    """Edges that touch, overlap, hold each other, are points or occur twice; stations on ends, between edges, twice."""
    monkeypatch.setattr(intervals, "WIDE", 50)
    rng = random.Random(8)
    edges = [(f"l{k % 4}", float(a := rng.randrange(-60, 300)), float(a + rng.choice([0, 1, 5, 30, 130])), f"u{k}", f"v{k}") for k in range(60)]
    edges += [("touch", 10.0 * k, 10.0 * k + 10, f"n{k}", f"n{k + 1}") for k in range(40)] + edges[:3] + [(None, 0.0, 9.0, "u", "v")]
    probes = [(line, float(s)) for line in ("l0", "l1", "l2", "l3", "touch", "gone", None) for s in range(-70, 450, 5)] * 2 + [("l0", None)]
    got = network.edge_of(spark.createDataFrame(edges, "line string, a double, b double, u string, v string"), spark.createDataFrame(probes, "line string, s double")).collect()
    want = set()
    for line, s in set(probes):
        hold = [e[1:] for e in edges if line is not None and s is not None and e[0] == line and e[1] <= s <= e[2]]
        want |= {(line, s, *min(hold))} if hold else set()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 150


def test_shuffles(spark, sf_dir, capsys):
    """A sweep shuffles its rows once, whatever it adds; before, the plans had 16 and 10 exchanges."""
    steps = spark.range(9).select(F.lit("l").alias("line"), F.col("id").alias("a"), F.lit(1).alias("v"), (F.col("id") + 1).alias("b"))
    assert shuffles(capsys, intervals.interval_sum(steps, "v")) <= 6
    assert shuffles(capsys, QUERIES["edge_at"](spark, sf_dir)) <= 7


def test_own_cells(spark):
    """A short line lies in one cell or a few, so its sides are hardly multiplied; a long one is parted. Before, cells were 100 wide."""
    rng = random.Random(2)
    step = lambda: rng.randrange(500)
    rows = [("short", step(), step(), step(), step()) for _ in range(60)] + [("long", x := step(), y := step(), x + 3, y + 3) for _ in range(3200)]
    cells = spatial.own_cells(spark.createDataFrame(rows, "line string, ax long, ay long, bx long, by_ long"), ("ax", "ay", "bx", "by_"))
    box = tuple(F.least(a, b) for a, b in (("ax", "bx"), ("ay", "by_"))) + tuple(F.greatest(a, b) for a, b in (("ax", "bx"), ("ay", "by_")))
    placed = spatial._cells(cells, box, F.col("_cell"), "l")
    n = {r["line"]: (r["n"], r["most"]) for r in placed.groupBy("line", "_cx", "_cy").count().groupBy("line").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}
    assert n["short"][0] < 1.5 * 60 and n["long"][0] < 2 * 3200 and n["long"][1] < 400
