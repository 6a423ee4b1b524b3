"""Queries of areas: free space between walls, hulls and least rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.operators import hulls, pockets
from calorgrid.plans.lines import VERTICES, vertices
from calorgrid.plans.tables import table
from calorgrid.queries import register

BARS = """bars AS (SELECT scene, x AS x1, y AS y1, x + CASE WHEN k % 2 = 1 THEN 20 + k % 17 ELSE 2 END AS x2, y + CASE WHEN k % 2 = 1 THEN 2 ELSE 20 + k % 17 END AS y2
FROM (SELECT p_partkey AS k, p_partkey // 40 AS scene, (p_partkey * 7919) % 61 AS x, (p_partkey * 104729) % 61 AS y FROM part)),
stands AS (SELECT c_custkey // 30 AS scene, (c_custkey * 7907) % 90 AS x, (c_custkey * 104723) % 90 AS y FROM customer)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, x1, y1, x2, y2: a long thin wall per part, 40 to a scene."""
    k = F.col("p_partkey")
    x, y, long_ = (k * 7919) % 61, (k * 104729) % 61, 20 + k % 17
    return table(spark, sf_dir, "part").select(F.floor(k / 40).alias("scene"), x.alias("x1"), y.alias("y1"), (x + F.when(k % 2 == 1, long_).otherwise(2)).alias("x2"), (y + F.when(k % 2 == 1, 2).otherwise(long_)).alias("y2"))


def stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, x, y: a supply per customer, 30 to a scene."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.floor(k / 30).alias("scene"), ((k * 7907) % 90).alias("x"), ((k * 104723) % 90).alias("y"))


@register("closed_pockets", f"""WITH RECURSIVE {BARS}, frame AS (SELECT scene, min(x1) - 1 AS lo, max(x2) AS hi, min(y1) - 1 AS low, max(y2) AS high FROM bars GROUP BY scene),
every AS (SELECT scene, x, unnest(range(low, high + 1)) AS y FROM (SELECT *, unnest(range(lo, hi + 1)) AS x FROM frame)),
solid AS (SELECT DISTINCT scene, x, unnest(range(y1, y2)) AS y FROM (SELECT scene, y1, y2, unnest(range(x1, x2)) AS x FROM bars)),
open AS (SELECT * FROM every EXCEPT SELECT * FROM solid),
outer_ AS (SELECT scene, lo AS x, low AS y FROM frame UNION SELECT o.scene, o.x, o.y FROM outer_ f, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy), open o WHERE o.scene = f.scene AND o.x = f.x + d.dx AND o.y = f.y + d.dy),
closed AS (SELECT * FROM open EXCEPT SELECT * FROM outer_),
first AS (SELECT * FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed n WHERE n.scene = c.scene AND (n.x = c.x - 1 AND n.y = c.y OR n.x = c.x AND n.y = c.y - 1))),
reach AS (SELECT scene, x AS fx, y AS fy, x, y FROM first UNION SELECT r.scene, r.fx, r.fy, c.x, c.y FROM reach r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy), closed c WHERE c.scene = r.scene AND c.x = r.x + d.dx AND c.y = r.y + d.dy),
label AS (SELECT scene, x, y, min(struct_pack(y := fy, x := fx)) AS l FROM reach GROUP BY scene, x, y)
SELECT l.scene, l.l.x AS x, l.l.y AS y, count(*) AS area, bool_or(s.x IS NOT NULL) AS supplied FROM label l LEFT JOIN (SELECT DISTINCT * FROM stands) s ON s.scene = l.scene AND s.x = l.x AND s.y = l.y GROUP BY l.scene, l.l""")
def closed_pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free space that walls close in, and whether a supply stands in it."""
    return pockets.pockets(bars(spark, sf_dir), stands(spark, sf_dir))


@register("least_rectangles", f"""WITH {VERTICES}, pts AS (SELECT DISTINCT line, x, y FROM vertices),
t AS (SELECT p.line, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) AS u, (r.y - p.y) * (q.x - p.x) - (r.x - p.x) * (q.y - p.y) AS w, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS n FROM pts p JOIN pts q ON p.line = q.line AND (p.x <> q.x OR p.y <> q.y) JOIN pts r ON r.line = p.line),
s AS (SELECT line, px, py, qx, qy, n, max(u) - min(u) AS along, max(w) AS across FROM t GROUP BY line, px, py, qx, qy, n HAVING min(w) >= 0 AND bool_and(w <> 0 OR u BETWEEN 0 AND n)),
b AS (SELECT *, count(*) OVER (PARTITION BY line) AS corners, CAST(along * across AS DOUBLE) / CAST(n AS DOUBLE) AS area, greatest(along, across) AS more, least(along, across) AS less FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY area, px, py, qx, qy) AS rn FROM b),
c AS (SELECT line, arg_max(x, event_id) - arg_min(x, event_id) AS cx, arg_max(y, event_id) - arg_min(y, event_id) AS cy FROM vertices GROUP BY line),
a AS (SELECT f.*, c.cx, c.cy, CASE WHEN along >= across THEN qx - px ELSE py - qy END AS ax, CASE WHEN along >= across THEN qy - py ELSE qx - px END AS ay FROM f JOIN c ON c.line = f.line WHERE rn = 1)
SELECT line, corners, round(area, 6) AS area, round(more / sqrt(CAST(n AS DOUBLE)), 6) AS length, round(less / sqrt(CAST(n AS DOUBLE)), 6) AS width, CASE WHEN less > 0 AND 5 * more >= 6 * less THEN abs(ax * cy - ay * cx) >= abs(ax * cx + ay * cy) END AS across FROM a""")
def least_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least rectangle around each user's corners, and whether the way from the first corner to the last crosses
    its axis at 45 degrees or more; null where the shape has no axis."""
    v = vertices(spark, sf_dir)
    way = lambda c: (F.max_by(c, "event_id") - F.min_by(c, "event_id")).alias(f"c{c}")
    found = hulls.least_rectangles(v).join(v.groupBy("line").agg(way("x"), way("y")), "line")
    digits = [F.round(c, 6).alias(c) for c in ("area", "length", "width")]
    return found.select("line", "corners", *digits, F.expr("abs(ax * cy - ay * cx) >= abs(ax * cx + ay * cy)").alias("across"))
