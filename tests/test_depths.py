"""Depths across trees against ways between all pairs."""

import random

from calorgrid.operators import depth

NODES = "node long, parent long, length long"
BALLS = "edge long, s long, r long, low long, high long"


def by_hand(nodes, balls, probes, normal, cover, slope):
    """Every probe against every ball, by the ways that climbing from both leads along."""
    up = {n: (p, 0 if p is None else m) for n, p, m in nodes}

    def ways(edge, s):
        found, at, way = {edge: up[edge][1] - s}, up[edge][0], s
        while at is not None:
            found[at], way, at = way, way + up[at][1], up[at][0]
        return found

    seen, out = {(e, s): ways(e, s) for e, s, *_ in [*balls, *probes]}, set()
    for edge, s in probes:
        lower, upper = cover, None
        for e, at, r, low, high in balls:
            both = [seen[edge, s][k] + seen[e, at][k] for k in seen[edge, s].keys() & seen[e, at].keys()]
            if edge == e:
                both.append(abs(s - at))
            if both:
                off = slope * max(0, min(both) - r)
                lower = max(lower, low - off) if low is not None else lower
                upper = high + off if high is not None and (upper is None or high + off < upper) else upper
        deep = max(normal, lower)
        out.add((edge, s, lower, upper, deep if upper is None else min(deep, upper), upper is not None and lower > upper))
    return out


def test_tree_envelope(spark):
    """Bushy trees, chains and a star at once; balls over nothing, one point, many edges and whole trees; edges of no
    length; two balls at one place, and one that bounds from both sides."""
    rng = random.Random(11)
    nodes = []
    for tree, shape in enumerate((lambda k: rng.randrange(k), lambda k: k - 1, lambda k: 0, lambda k: max(0, k - rng.randrange(1, 4)))):
        nodes += [(100 * tree + k, None if k == 0 else 100 * tree + shape(k), rng.choice([0, 1, 7, 40])) for k in range(25)]
    real = [n for n in nodes if n[1] is not None]
    some = lambda: rng.choice(real)
    balls = []
    for k in range(40):
        edge, _, length = some()
        low, high = (rng.randrange(80, 500) if k % 3 else None), (rng.randrange(200, 700) if k % 3 != 1 else None)
        balls.append((edge, rng.randrange(length + 1), rng.choice([0, 1, 5, 30, 500]), low, high))
    balls.append(balls[0][:3] + (450, 460))
    probes = sorted({(e, s) for e, _, m in real for s in {0, m // 2, m, rng.randrange(m + 1)}})
    given = lambda rows, kind: spark.createDataFrame(rows, kind)
    for chosen in (balls, [b for b in balls if b[0] >= 100 and b[2] < 500], []):
        got = depth.tree_envelope(given(nodes, NODES), given(chosen, BALLS), given(probes, "edge long, s long"), 150, 70, 2).collect()
        want = by_hand(nodes, chosen, probes, 150, 70, 2)
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tree_envelope_outside(spark):
    """Nodes on a cycle, probes and balls on edges that are none, and an empty tree give no row."""
    nodes = spark.createDataFrame([(0, None, 9), (1, 0, 10), (5, 6, 3), (6, 5, 3)], NODES)
    balls = spark.createDataFrame([(9, 0, 2, 500, None), (5, 1, 2, 500, None), (1, 10, 0, 400, None)], BALLS)
    probes = spark.createDataFrame([(1, 0), (5, 0), (9, 0), (0, 0)], "edge long, s long")
    assert [tuple(r)[:3] for r in depth.tree_envelope(nodes, balls, probes, 100, 70, 10).collect()] == [(1, 0, 300)]
    assert depth.tree_envelope(nodes.where("false"), balls, probes).count() == 0
