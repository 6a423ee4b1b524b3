"""Steps whose cost must not outgrow the input: how joins and groups are planned, and the pairs that searches form."""

import random

from pyspark.sql import functions as F

from calorgrid import plans, queries  # noqa: F401  importing plans fills the registry
from calorgrid.operators import lineage, spatial


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cell_joins_shuffle(spark, sf_dir):
    """The planner takes exploded cells for as small as the file that they come from and would broadcast them."""
    for name in ("point_in_polygon", "polygon_pieces", "clearance_margin", "cell_join", "part_overlap", "crossing_points"):
        assert "BroadcastHashJoin" not in plan(queries.QUERIES[name](spark, sf_dir)), name


def test_large_tables_shuffle(spark, monkeypatch):
    """A written table of a few bytes a row is no small one."""
    small, other = lineage.cut(spark.range(100)), spark.range(50)
    assert "BroadcastHashJoin" in plan(other.join(small, "id"))
    monkeypatch.setattr(lineage, "LARGE", 10)
    assert "BroadcastHashJoin" not in plan(other.join(lineage.cut(spark.range(100)).where("id > 3"), "id"))


def test_nearest_line(spark, sf_dir):
    """Against all pairs, in integers: upright and level lines, points as lines, equal lines, points too far from any."""
    rng = random.Random(7)
    segs = [(k, *(rng.randrange(-150, 150) for _ in range(4))) for k in range(60)] + [(60, 10, -90, 10, 80), (61, -80, 5, 70, 5), (62, 33, 33, 33, 33), (63, 33, 33, 33, 33)]
    segs += [(100 + s[0], *s[1:]) for s in segs[:20]]
    pts = [(k, rng.randrange(-400, 400), rng.randrange(-400, 400)) for k in range(150)] + [(900, 33, 33), (901, 10, 80), (902, 5000, 5000)]
    p, s = spark.createDataFrame(pts, "point long, x long, y long"), spark.createDataFrame(segs, "line long, ax long, ay long, bx long, by_ long")

    def d2(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        u, n = (x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy
        if u <= 0 or u >= n:
            return float(min((x - ax) ** 2 + (y - ay) ** 2, (x - bx) ** 2 + (y - by) ** 2))
        return ((x - ax) * dy - (y - ay) * dx) ** 2 / n

    for most in (40, 300):
        want = {}
        for key, x, y in pts:
            least, line = min((d2(x, y, *r[1:]), r[0]) for r in segs)
            if least <= most * most:
                want[key] = line, least
        got = spatial.nearest_line(p, s, most).collect()
        assert len(got) == len(want) and {r["point"]: (r["line"], r["d2"]) for r in got} == want
    assert spatial.nearest_line(p, s.where("line < 0"), 300).count() == 0
    # no line of a table without lines, and no sort of pairs
    assert "SortAggregate" not in plan(queries.QUERIES["nearest_line"](spark, sf_dir))


def test_nearest_pairs(spark, monkeypatch):
    """A dense table of roots makes no more pairs a point than a sparse one."""
    pairs, inner = [], spatial.near

    def near(*args):
        found = inner(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(spatial, "near", near)
    roots = spark.range(8000).select(F.col("id").alias("root"), (F.col("id") * 7919 % 1000).alias("lx"), (F.col("id") * 104729 % 1000).alias("ly"))
    points = spark.range(50).select(F.col("id").alias("point"), (F.col("id") * 911 % 1000).alias("x"), (F.col("id") * 577 % 1000).alias("y"))
    at = tuple(F.col(c) for c in ("lx", "ly", "lx", "ly"))
    d2 = F.expr("(x - lx) * (x - lx) + (y - ly) * (y - ly)")
    got = spatial.nearest(points, roots, at, d2, F.expr("cast(r as bigint) * r"), 3, 450, "root").collect()
    assert len(got) == 150 and sum(pairs) < 50 * 100
    r, p = roots.collect(), points.collect()
    for q in p:
        best = sorted(((q["x"] - a["lx"]) ** 2 + (q["y"] - a["ly"]) ** 2, a["root"]) for a in r)[:3]
        assert [b[1] for b in best] == [g["root"] for g in sorted(got, key=lambda g: g["rank"]) if g["point"] == q["point"]]


def test_groups_without_sorts(spark, sf_dir):
    """Pairs are counted as they come: no sort of all pairs of a point, no group a pair."""
    assert "SortAggregate" not in plan(queries.QUERIES["terminal_diagnostics"](spark, sf_dir))
    text = plan(queries.QUERIES["disjoint_groups"](spark, sf_dir))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text and text.index("SortMergeJoin") < text.index("Aggregate")
