"""Pieces of lines in rings, loads of existing edges and thinned lines against plain loops."""

import random

from calorgrid.operators import lines, sizing, spatial
from calorgrid.plans.lines import thinned_lines, vertices


def inside(x, y, sides):
    hits = 0
    for x1, y1, x2, y2 in sides:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hits += 1
    return hits % 2 == 1


def test_pieces(spark):
    """Against a sweep in small steps: random stars with and without holes, lines from anywhere to anywhere."""
    from math import cos, pi, sin

    rng = random.Random(4)
    sides, rings = [], {}
    for ring in range(12):
        cx, cy, n = rng.randrange(300), rng.randrange(300), rng.randrange(3, 11)
        rings[ring] = []
        for scale in (1.0, 0.4) if ring % 3 else (1.0,):
            p = [(round(cx + scale * r * cos(2 * pi * k / n)), round(cy + scale * r * sin(2 * pi * k / n))) for k, r in enumerate(rng.randrange(20, 80) for _ in range(n))]
            rings[ring] += [(*a, *b) for a, b in zip(p, p[1:] + p[:1])]
        sides += [(ring, *s) for s in rings[ring]]
    segs = [(k, *(rng.randrange(-50, 350) for _ in range(4))) for k in range(60)]
    got = spatial.pieces(spark.createDataFrame(segs, "line long, ax long, ay long, bx long, by_ long"), spark.createDataFrame(sides, "ring long, x1 long, y1 long, x2 long, y2 long"), 40).collect()
    assert len(got) > 50
    by = {}
    for r in got:
        by.setdefault((r["line"], r["ring"]), []).append((r["piece"], r["entry"], r["exit"], r["single"]))
    for key, ax, ay, bx, by_ in segs:
        m = ((bx - ax) ** 2 + (by_ - ay) ** 2) ** 0.5
        for ring, of in rings.items():
            found = sorted(by.get((key, ring), []))
            assert [p[0] for p in found] == list(range(1, len(found) + 1)) and all(p[3] == (len(found) == 1) for p in found)
            for k in range(400):
                t = (k + 0.5) / 400
                near_end = any(abs(t * m - s) < 1e-3 for p in found for s in p[1:3])
                x, y = ax + t * (bx - ax), ay + t * (by_ - ay)
                assert near_end or inside(x, y, of) == any(p[1] < t * m < p[2] for p in found)


def test_reconstruction(spark):
    """Against climbing the way of every tie; edges with and without ties, ties at both ends, an empty table of ties."""
    rng = random.Random(9)
    edges = [(k, rng.randrange(k) if k % 10 else None, rng.randrange(1, 200), rng.randrange(1, 60)) for k in range(60)]
    ties = [(k % 59, rng.choice([0, edges[k % 59][2], rng.randrange(edges[k % 59][2] + 1)]), rng.randrange(1, 40)) for k in range(90)]
    e = spark.createDataFrame(edges, "edge long, parent long, length long, flow int").selectExpr("edge", "parent", "length", "cast(flow as decimal(12,2)) AS flow", "50 AS dn")
    t = spark.createDataFrame(ties, "edge long, station long, flow int").selectExpr("edge", "station", "cast(flow as decimal(12,2)) AS flow")
    got = {(r["edge"], r["a"], r["b"]): (r["added"], r["new_dn"]) for r in sizing.reconstruction(e, t).collect()}
    load = {}
    for at, station, flow in ties:
        while at is not None:
            for m in range(station):
                load[at, m] = load.get((at, m), 0) + flow
            at = edges[at][1]
            station = edges[at][2] if at is not None else 0
    per_metre = {(k, m): added for (k, a, b), (added, _) in got.items() for m in range(a, b)}
    assert len(per_metre) == sum(b - a for _, a, b in got)
    assert got and all(load[k] == v for k, v in per_metre.items())
    from calorgrid.functions import catalog

    carries = lambda flow: next((p[0] for p in catalog.PIPES if flow <= float(p[1])), None)
    narrow = {k for k, v in load.items() if (carries(edges[k[0]][3] + v) or 10**6) > 50}
    assert set(per_metre) == narrow
    assert sizing.reconstruction(e, t.where("false")).count() == 0


def thin_by_hand(p, tolerance):
    if len(p) < 3:
        return p
    (_, ax, ay), (_, bx, by) = p[0], p[-1]
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy

    def d2(q):
        ex, ey = q[1] - ax, q[2] - ay
        u = ex * dx + ey * dy
        if u <= 0 or u >= n:
            return float(min(ex * ex + ey * ey, (q[1] - bx) ** 2 + (q[2] - by) ** 2))
        return float((ex * dy - ey * dx) ** 2) / float(n)

    k = max(range(1, len(p) - 1), key=lambda i: (d2(p[i]), -i))
    if d2(p[k]) <= tolerance * tolerance:
        return [p[0], p[-1]]
    return thin_by_hand(p[: k + 1], tolerance)[:-1] + thin_by_hand(p[k:], tolerance)


def test_thin(spark, sf_dir):
    """Every polyline of the table, closed and short ones, corners that coincide."""
    given = {}
    for r in vertices(spark, sf_dir).collect():
        given.setdefault(r["line"], []).append((r["event_id"], r["x"], r["y"]))
    want = sorted((k, *q) for k, p in given.items() for q in thin_by_hand(sorted(p), 1500.0))
    got = sorted(map(tuple, thinned_lines(spark, sf_dir).collect()))
    assert got == want and len(got) < sum(map(len, given.values()))
    odd = {1: [(0, 0, 0)], 2: [(0, 0, 0), (1, 9, 9)], 3: [(0, 0, 0), (1, 5, 0), (2, 5, 5), (3, 0, 0)], 4: [(k, 7, 7) for k in range(5)], 5: [(k, k, 3 * (k % 2)) for k in range(9)]}
    df = spark.createDataFrame([(k, *q) for k, p in odd.items() for q in p], "line long, seq long, x long, y long")
    assert sorted(map(tuple, lines.thin(df, 2.0).collect())) == sorted((k, *q) for k, p in odd.items() for q in thin_by_hand(p, 2.0))
    assert lines.thin(df.where("false"), 2.0).count() == 0
