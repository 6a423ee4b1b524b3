"""Pockets against a flood fill, islands of stretches against a sweep."""

import random

import pytest

from calorgrid.operators import hulls, intervals, pockets

WALLS, STANDS = "scene string, x1 int, y1 int, x2 int, y2 int", "scene string, x int, y int"


def flood(walls, stands):
    """Per scene: fill from outside, then fill what is left, first cells first."""
    out = set()
    for scene in {w[0] for w in walls}:
        own = [w[1:] for w in walls if w[0] == scene and None not in w and w[1] < w[3] and w[2] < w[4]]
        solid = {(y, x) for x1, y1, x2, y2 in own for x in range(x1, x2) for y in range(y1, y2)}
        if not solid:
            continue
        ys, xs = {c[0] for c in solid}, {c[1] for c in solid}
        left = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)} - solid
        for n, start in enumerate(sorted(left)):
            if start not in left:
                continue
            todo, region = [start], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.remove((y, x))
                    region.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            if n:
                out.add((scene, start[1], start[0], len(region), any((y, x) in region for s, x, y in stands if s == scene)))
    return out


def test_islands(spark):
    """Stretches that come many times over, and such that start or end together, against a plain sweep."""
    rng = random.Random(8)
    rows = [(a, a + rng.choice([1, 2])) for a in (rng.randrange(-200, 200) for _ in range(120)) for _ in range(rng.choice([1, 2, 30]))]
    rng.shuffle(rows)
    got = intervals.islands(spark.createDataFrame([("l", *r) for r in rows], "line string, a long, b long").repartition(7), ["line"])
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1] = [want[-1][0], max(b, want[-1][1]), want[-1][2] + 1]
        else:
            want.append([a, b, 1])
    assert sorted([r["a"], r["b"], r["n"]] for r in got.collect()) == want


def test_pockets(spark):
    """Random walls below and above zero; rings in rings, corners that touch, runs longer than a cell of the join,
    scenes without pockets, walls without extent, repeated walls and nulls."""
    rng = random.Random(3)
    walls = []
    for k in range(160):
        x, y, m = rng.randrange(-30, 30), rng.randrange(-30, 30), rng.randrange(4, 25)
        walls.append((f"s{k % 4}", x, y, *((x + m, y + 1) if rng.random() < 0.5 else (x + 1, y + m))))
    ring = lambda s, a, b: [(s, a, a, b, a + 1), (s, a, b - 1, b, b), (s, a, a, a + 1, b), (s, b - 1, a, b, b)]
    walls += ring("rings", 0, 300) + ring("rings", 100, 200) + ring("rings", 140, 141 + 30)
    walls += [("corner", 0, 0, 1, 1), ("corner", 1, 1, 2, 2), ("corner", 0, 2, 1, 3), ("corner", -1, 1, 0, 2)]
    walls += [("free", 0, 0, 5, 5), ("none", 3, 3, 3, 9), ("rings", None, 1, 2, 3), ("free", 0, 0, 5, 5)]
    stands = [(f"s{k % 4}", rng.randrange(-30, 50), rng.randrange(-30, 50)) for k in range(80)] + [("rings", 150, 150), ("rings", 0, 0), ("rings", 1, 1), ("rings", 1, 1), ("gone", 1, 1)]
    got = pockets.pockets(spark.createDataFrame(walls, WALLS), spark.createDataFrame(stands, STANDS)).collect()
    want = flood(walls, stands)
    assert {tuple(r) for r in got} ^ want == set() and len(got) == len(want) > 10
    assert ("rings", 1, 1, 298 * 298 - 100 * 100, True) in want and ("corner", 0, 1, 1, False) in want
    empty = spark.createDataFrame([], WALLS)
    assert pockets.pockets(empty, spark.createDataFrame(stands, STANDS)).count() == 0


def wrap(points):
    """Sides by every pair of points with all others to its left, as (p, q, along, across)."""
    points = sorted(set(points))
    if len(points) == 1:
        return {(*points[0], *points[0], 0, 0)}
    out = set()
    for px, py in points:
        for qx, qy in points:
            dx, dy = qx - px, qy - py
            u = [(x - px) * dx + (y - py) * dy for x, y in points]
            w = [(y - py) * dx - (x - px) * dy for x, y in points]
            if (dx or dy) and min(w) >= 0 and all(b or 0 <= a <= dx * dx + dy * dy for a, b in zip(u, w)):
                out.add((px, py, qx, qy, max(u) - min(u), max(w)))
    return out


def test_hulls(spark):
    """Grids with many points on a side, thin and steep shapes over several blocks, single points, pairs, points on a
    line in every direction, repeated rows and nulls, and an empty table."""
    rng = random.Random(6)
    shapes = {f"r{k}": [(rng.randrange(-m, m), rng.randrange(-h, h)) for _ in range(n)] for k, (n, m, h) in enumerate([(3, 9, 9), (40, 4, 4), (60, 3000, 5), (60, 5, 3000), (80, 2500, 2500), (5, 2, 2), (4, 2, 2), (30, 6, 3)])}
    shapes |= {"one": [(5, -5)], "same": [(2, 2)] * 5, "two": [(0, 0), (-3000, 7)], "flat": [(k, 3) for k in range(9)], "up": [(3, k) for k in range(9)], "slope": [(700 * k, -k) for k in range(6)], "box": [(x, y) for x in range(5) for y in range(4)]}
    rows = [(s, *p) for s, of in shapes.items() for p in of] + [("one", None, 3), ("one", 3, None), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "line string, x int, y int")
    got = {}
    for r in hulls.sides(df).collect():
        got.setdefault(r["line"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(wrap(p)) for k, p in shapes.items()}
    best = {r["line"]: r for r in hulls.least_rectangles(df).collect()}
    assert best["box"]["area"] == 12 and (best["box"]["ax"], best["box"]["ay"]) == (4, 0)
    assert all(best[k]["ax"] is None and best[k]["area"] == 0 for k in ("one", "two", "flat", "up", "slope"))
    assert hulls.sides(df.where("false")).count() == 0


def test_hulls_stream(spark, capsys):
    """Shapes follow each other in a stream instead of a call per shape, whatever batches divide them."""
    rng = random.Random(9)
    shapes = {k: [(rng.randrange(-1500, 1500), rng.randrange(-40, 40)) for _ in range(rng.randrange(1, 40))] for k in [None, *range(30)]}
    df = spark.createDataFrame([(k, *p) for k, of in shapes.items() for p in of], "line long, x int, y int")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        found = hulls.sides(df)
        found.explain()
        got = {}
        for r in found.collect():
            got.setdefault(r["line"], []).append(tuple(r)[1:])
    finally:
        spark.conf.set(size, before)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(wrap(p)) for k, p in shapes.items()}
    assert "FlatMapGroups" not in capsys.readouterr().out


@pytest.mark.parametrize("high, most", [(8, 1 << 13), (1, 1 << 13), (64, 60)])
def test_pockets_in_tiles(spark, monkeypatch, high, most):
    """Pockets over many tiles, tiles that no wall meets, tiles over several batches, and scenes that have too many walls
    in one, which go by runs alone; with tiles no row of a wall is shuffled on its own."""
    monkeypatch.setattr(pockets, "HIGH", high)
    monkeypatch.setattr(pockets, "MOST", most)
    rng = random.Random(high)
    walls = []
    for k in range(220):
        x, y, m = rng.randrange(-30, 30), rng.randrange(-40, 40), rng.randrange(4, 25)
        walls.append((f"s{k % 3}", x, y, *((x + m, y + 1) if rng.random() < 0.5 else (x + 1, y + m))))
    ring = lambda s, a, b: [(s, a, a, b, a + 1), (s, a, b - 1, b, b), (s, a, a, a + 1, b), (s, b - 1, a, b, b)]
    walls += ring("rings", 0, 90) + ring("rings", 30, 60) + ring("far", 0, 5) + ring("far", 70, 75) + [(None, 0, 0, 5, 5)]
    walls += [("comb", 0, 0, 41, 1), ("comb", 0, 0, 1, 40), ("comb", 40, 0, 41, 40), ("comb", 0, 40, 41, 41)] + [("comb", 4 * k, 1 if k % 2 else 4, 4 * k + 1, 37 if k % 2 else 40) for k in range(1, 10)]
    stands = [(f"s{k % 3}", rng.randrange(-30, 50), rng.randrange(-40, 60)) for k in range(90)] + [("comb", 39, 39), ("far", 300, 1), ("far", 2, 2), ("rings", 1, 1), ("gone", 1, 1), ("rings", None, 1)]
    runs = []
    free_runs = pockets.free_runs
    monkeypatch.setattr(pockets, "free_runs", lambda w, key: runs.append(w.count()) or free_runs(w, key))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        got = pockets.pockets(spark.createDataFrame(walls, WALLS), spark.createDataFrame(stands, STANDS)).collect()
    finally:
        spark.conf.set(size, before)
    want = flood([w for w in walls if w[0]], stands)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10
    assert bool(runs) == (most == 60) and sum(runs) < len(walls)  # before, always and all
