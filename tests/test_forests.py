"""Forests by cheapest insertion against insertions one by one, and trees turned by round trips."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from calorgrid.functions import catalog
from calorgrid.operators import forests, network, search, tours

PRICE = {p[0]: float(p[catalog.COLUMNS.index("new_price")]) for p in catalog.PIPES}


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


class Plain:
    """One forest that demands join one after the other, each by its cheapest way."""

    def __init__(self, roots, walls):
        self.roots, self.walls, self.rays, self.pipes = roots, walls, {r: 0 for r in roots}, {}

    def ways(self, d, x, y, dn):
        clear = lambda q: not any(crosses((x, y), q, a, b) for a, b in self.walls)
        price, out = PRICE[dn], []
        for r, (rx, ry, free) in self.roots.items():
            if self.rays[r] < free and clear((rx, ry)):
                out.append((round(price * math.hypot(x - rx, y - ry), 2) + (0 if self.rays[r] else float(catalog.TIE_IN_PRICE)), "root", str(r), (rx, ry)))
        for name, ((ux, uy), (vx, vy)) in self.pipes.items():
            whole = math.hypot(vx - ux, vy - uy)
            s = ((x - ux) * (vx - ux) + (y - uy) * (vy - uy)) / whole
            q = (ux + s / whole * (vx - ux), uy + s / whole * (vy - uy))
            if 2 <= s <= whole - 2 and math.hypot(x - q[0], y - q[1]) > 0.1 and clear(q):
                out.append((price * math.hypot(x - q[0], y - q[1]) + forests.BRANCH_PRICE, "branch", name, q))
        return sorted(out)

    def take(self, d, x, y, kind, target, q):
        if kind == "root":
            self.rays[int(target)] += 1
        else:
            u, v = self.pipes.pop(target)
            self.pipes[f"{d}<"], self.pipes[f"{d}>"] = (u, q), (q, v)
        self.pipes[str(d)] = (q, (x, y))


def test_forests_grow_as_one_by_one(spark):
    rng = random.Random(2)
    demands, roots, walls = [], [], []
    for scene, n in enumerate((1, 5, 5, 9)):
        demands += [(scene, k, float(rng.randrange(900)), float(rng.randrange(900)), rng.choice([5.0, 30.0, 90.0])) for k in range(n)]
        roots += [(scene, 100 + k, float(rng.randrange(900)), float(rng.randrange(900)), rng.choice([1, 2, 3])) for k in range(3)]
        walls += [(scene, k, "building", *(float(rng.randrange(900)) for _ in range(4))) for k in range(4 if scene > 1 else 0)]
    d = spark.createDataFrame(demands, "scene_id int, demand long, x double, y double, flow double")
    r = spark.createDataFrame(roots, "scene_id int, root long, rx double, ry double, free int")
    w = spark.createDataFrame(walls, "scene_id int, wall long, kind string, x1 double, y1 double, x2 double, y2 double")
    pipes, ways = forests.grow(d, r, w)
    taken = sorted((x.asDict() for x in ways.collect()), key=lambda x: (x["scene_id"], x["turn"], x["cost"], x["demand"]))
    dn = {(x["scene_id"], x["demand"]): x["dn"] for x in d.withColumn("dn", catalog.base_dn(F.col("flow").cast("decimal(12,2)"))).collect()}
    assert any(x["kind"] == "branch" for x in taken)
    for scene in range(4):
        plain = Plain({k: (x, y, f) for s, k, x, y, f in roots if s == scene}, [((a, b), (c, e)) for s, _, _, a, b, c, e in walls if s == scene])
        at = {k: (x, y) for s, k, x, y, _ in demands if s == scene}
        for t in (t for t in taken if t["scene_id"] == scene):
            x, y = at.pop(t["demand"])
            best = plain.ways(t["demand"], x, y, dn[scene, t["demand"]])[0]
            assert t["cost"] == pytest.approx(best[0], abs=0.02) and (t["kind"], t["target"]) == best[1:3]
            plain.take(t["demand"], x, y, t["kind"], t["target"], (t["qx"], t["qy"]))
        assert all(not plain.ways(k, x, y, dn[scene, k]) for k, (x, y) in at.items())  # those left have no way in
        got = {p["pipe"]: ((p["ux"], p["uy"]), (p["vx"], p["vy"])) for p in pipes.where(F.col("scene_id") == scene).collect()}
        assert got == plain.pipes


def test_forests_are_one_of_all_orders(spark):
    """On scenes of four demands around one far root the result is that of one order of insertion, not always the cheapest."""
    rng = random.Random(7)
    demands = [(s, k, 600 + 300 * rng.random(), 600 + 300 * rng.random(), 30.0) for s in range(4) for k in range(4)]
    d = spark.createDataFrame(demands, "scene_id int, demand long, x double, y double, flow double")
    r = spark.createDataFrame([(s, 1, 0.0, 0.0, 4) for s in range(4)], "scene_id int, root long, rx double, ry double, free int")
    w = spark.createDataFrame([], "scene_id int, wall long, kind string, x1 double, y1 double, x2 double, y2 double")
    _, ways = forests.grow(d, r, w)
    got = {x["scene_id"]: x["cost"] for x in ways.groupBy("scene_id").agg(F.sum("cost").alias("cost")).collect()}
    dn = spark.range(1).select(catalog.base_dn(F.lit(30).cast("decimal(12,2)"))).first()[0]
    for s in range(4):
        own, totals = [x for x in demands if x[0] == s], []
        for order in itertools.permutations(own):
            plain, total = Plain({1: (0.0, 0.0, 4)}, []), 0.0
            for _, k, x, y, _ in order:
                cost, kind, target, q = plain.ways(k, x, y, dn)[0]
                plain.take(k, x, y, kind, target, q)
                total += cost
            totals.append(total)
        assert any(abs(got[s] - t) < 0.1 for t in totals)


def test_layout_prices(spark):
    """A demand on a trunk: the trunk carries both flows, and every price adds up."""
    d = spark.createDataFrame([(1, 1, 1000.0, 0.0, 30.0), (1, 2, 500.0, 40.0, 20.0), (1, 3, 9.0, 9.0, 1e9)], "scene_id int, demand long, x double, y double, flow double")
    r = spark.createDataFrame([(1, 9, 0.0, 0.0, 2)], "scene_id int, root long, rx double, ry double, free int")
    w = spark.createDataFrame([], "scene_id int, wall long, kind string, x1 double, y1 double, x2 double, y2 double")
    pipes, best = forests.layouts(d, r, w, restarts=1)
    got = {p["pipe"]: (float(p["flow"]), float(p["length"])) for p in pipes.collect()}
    b = best.first()
    if "2<" in got:
        assert got == {"2<": (50.0, 500.0), "2>": (30.0, 500.0), "2": (20.0, 40.0)}
    assert (b["connected"], b["missing"], b["ties"]) == (2, 1, 1)
    assert float(b["cost"]) == pytest.approx(sum(float(p["cost"]) for p in pipes.collect()) + float(catalog.TIE_IN_PRICE) + b["chambers"] * forests.BRANCH_PRICE + 1e8 + 5e5 * 1e9)


def test_orientation(spark, monkeypatch):
    rounds, cut = [], tours.cut
    monkeypatch.setattr(tours, "cut", lambda *a: rounds.append(1) or cut(*a))
    rng = random.Random(2)
    up = {k: k - 1 for k in range(1, 5000)} | {k: rng.randrange(6000, k) for k in range(6001, 6400)} | {k: 7000 for k in range(7001, 7100)}
    rows = [(k, a, b) if rng.random() < 0.5 else (k, b, a) for k, (b, a) in enumerate(up.items())]
    rng.shuffle(rows)
    got = tours.orient(spark.createDataFrame(rows, "id long, a long, b long"), spark.createDataFrame([(0,), (6000,), (7000,)], "node long"))
    assert {r["down"]: r["up"] for r in got.collect()} == up
    assert len(rounds) < 20


def test_lists_without_an_end(spark):
    with pytest.raises(RuntimeError):
        tours.ranks(spark.createDataFrame([(1, 2), (2, 1)], "item long, next long"))


def test_breadth_from_several_sources(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    depth, front = {0: 0, 7: 0}, [0, 7]
    while front:
        front = sorted({b for a in front for b in near.get(a, ()) if b not in depth and not depth.update({b: depth[a] + 1})})
    got = network.depths(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (7,)], "node long")).collect()
    assert {r["node"]: r["depth"] for r in got} == depth
    assert all(r["parent"] == min(n for n in near[r["node"]] if depth.get(n) == r["depth"] - 1) for r in got if r["depth"])
