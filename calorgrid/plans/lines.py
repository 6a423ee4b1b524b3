"""Stretches of lines and polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from calorgrid.operators import depth, intervals, lines
from calorgrid.plans.tables import table
from calorgrid.queries import register

ZONES = "zones AS (SELECT user_id AS line, event_id % 1000 AS a, event_id % 1000 + 3 + event_id % 40 AS b, CAST(CASE WHEN event_id % 5 = 0 THEN 1.6 WHEN event_id % 5 = 1 THEN 1.75 WHEN event_id % 5 = 2 THEN 1.25 WHEN event_id % 5 = 3 THEN 1.15 ELSE 1.05 END AS DECIMAL(4,2)) AS k, event_id FROM events)"
ELEMENTARY = "ends AS (SELECT line, a FROM zones UNION SELECT line, b FROM zones), parts AS (SELECT * FROM (SELECT line, a, lead(a) OVER (PARTITION BY line ORDER BY a) AS b FROM ends) WHERE b IS NOT NULL)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, a, b, k, event_id: a stretch with a factor per event, on the line of its user."""
    e = F.col("event_id")
    k = F.element_at(F.array(*[F.lit(x).cast("decimal(4,2)") for x in ("1.6", "1.75", "1.25", "1.15", "1.05")]), (e % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), (e % 1000).alias("a"), (e % 1000 + 3 + e % 40).alias("b"), k.alias("k"), "event_id")


@register("zones_piecewise_max", f"WITH {ZONES}, {ELEMENTARY} SELECT p.line, p.a, p.b, max(z.k) AS k FROM parts p JOIN zones z ON z.line = p.line AND z.a <= p.a AND z.b >= p.b GROUP BY p.line, p.a, p.b HAVING max(z.k) > 1")
def zones_piecewise_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.piecewise_max(zones(spark, sf_dir))


@register("zones_interval_sum", f"WITH {ZONES}, {ELEMENTARY} SELECT p.line, p.a, p.b, CAST(sum(z.event_id) AS BIGINT) AS total FROM parts p JOIN zones z ON z.line = p.line AND z.a <= p.a AND z.b >= p.b GROUP BY p.line, p.a, p.b")
def zones_interval_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_sum(zones(spark, sf_dir), "event_id")


@register("zones_union_max", f"""WITH {ZONES}, m AS (SELECT *, max(b) OVER (PARTITION BY line ORDER BY a, b, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM zones),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY a, b, k ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT line, min(a) AS a, max(b) AS b, max(k) AS k, count(*) AS n, string_agg(DISTINCT CAST(k AS VARCHAR), '+' ORDER BY CAST(k AS VARCHAR)) AS sources FROM g GROUP BY line, grp""")
def zones_union_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_max(zones(spark, sf_dir))


@register("zone_factor_at", f"WITH {ZONES}, p AS (SELECT DISTINCT user_id AS line, (event_id * 13) % 1000 AS s FROM events) SELECT p.line, p.s, coalesce(max(z.k), CAST(1 AS DECIMAL(4,2))) AS k FROM p LEFT JOIN zones z ON z.line = p.line AND p.s BETWEEN z.a AND z.b GROUP BY p.line, p.s")
def zone_factor_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), ((F.col("event_id") * 13) % 1000).alias("s")).distinct()
    return intervals.factor_at(zones(spark, sf_dir), probes)


@register("cut_pieces", f"""WITH {ZONES}, l AS (SELECT line, max(b) + 25 AS length FROM zones GROUP BY line), s AS (SELECT line, 0 AS a FROM l UNION SELECT line, length FROM l UNION SELECT line, a FROM zones UNION SELECT line, b FROM zones),
p AS (SELECT * FROM (SELECT line, a, lead(a) OVER (PARTITION BY line ORDER BY a) AS b, row_number() OVER (PARTITION BY line ORDER BY a) - 1 AS piece FROM s) WHERE b IS NOT NULL)
SELECT p.line, CAST(p.piece AS INTEGER) AS piece, p.a, p.b, coalesce(max(z.k), CAST(1 AS DECIMAL(4,2))) AS k FROM p LEFT JOIN zones z ON z.line = p.line AND z.a <= p.a AND z.b >= p.b GROUP BY p.line, p.piece, p.a, p.b""")
def cut_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir)
    return intervals.cut(z.groupBy("line").agg((F.max("b") + 25).alias("length")), z)


VERTICES = "vertices AS (SELECT user_id AS line, event_id, (event_id * 7919) % 5000 AS x, (event_id * 104729) % 5000 AS y FROM events)"
TURNS = "turns AS (SELECT line, event_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY line ORDER BY event_id))"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, event_id, x, y: the corners of a polyline per user, in order of event_id."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), "event_id", ((e * 7919) % 5000).alias("x"), ((e * 104729) % 5000).alias("y"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("event_id")
    return vertices(spark, sf_dir).select("line", "event_id", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))


@register("polyline_station", f"WITH {VERTICES}, {TURNS} SELECT line, event_id, round(sum(coalesce(sqrt(CAST((x - px) * (x - px) + (y - py) * (y - py) AS DOUBLE)), 0)) OVER (PARTITION BY line ORDER BY event_id), 6) AS station FROM turns")
def polyline_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station of each corner: the length of the line up to it."""
    step = F.sqrt(F.expr("(x - px) * (x - px) + (y - py) * (y - py)").cast("double"))
    rows = turns(spark, sf_dir).withColumn("_step", F.coalesce(step, F.lit(0.0)))
    rows = intervals.running(rows, ["line"], ["event_id"], "_step", "sum", "station")
    return rows.select("line", "event_id", F.round("station", 6).alias("station"))


DOT = "((x - px) * (nx - x) + (y - py) * (ny - y))"
CROSS = "((x - px) * (ny - y) - (y - py) * (nx - x))"


@register("polyline_turns", f"WITH {VERTICES}, {TURNS} SELECT line, event_id, {DOT} >= 0 AS allowed, CAST(sign({CROSS}) AS INTEGER) AS side FROM turns WHERE px IS NOT NULL AND nx IS NOT NULL")
def polyline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a corner turns by at most a right angle, and to which side."""
    return turns(spark, sf_dir).where("px is not null and nx is not null").select("line", "event_id", (F.expr(DOT) >= 0).alias("allowed"), F.signum(F.expr(CROSS)).cast("int").alias("side"))


@register("straight_corners", """WITH v AS (SELECT user_id AS line, event_id, event_id % 6 AS x, event_id % 3 AS y FROM events), t AS (SELECT line, event_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY line ORDER BY event_id))
SELECT line, event_id, x, y FROM t WHERE px IS NULL OR nx IS NULL OR (x - px) * (ny - y) - (y - py) * (nx - x) <> 0 OR (x - px) * (nx - x) + (y - py) * (ny - y) < 0""")
def straight_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners without those that lie straight between their neighbours."""
    e, w = F.col("event_id"), Window.partitionBy("line").orderBy("event_id")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), "event_id", (e % 6).alias("x"), (e % 3).alias("y"))
    t = v.select("line", "event_id", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    return t.where(F.col("px").isNull() | F.col("nx").isNull() | (F.expr(CROSS) != 0) | (F.expr(DOT) < 0)).select("line", "event_id", "x", "y")


@register("kink_quality", f"""WITH {VERTICES}, {TURNS}, q AS (SELECT line, (x - px) * (x - px) + (y - py) * (y - py) AS l2, (nx - x) * (nx - x) + (ny - y) * (ny - y) AS n2, {DOT} AS dot, {CROSS} AS cr FROM turns WHERE px IS NOT NULL)
SELECT line, count(*) AS segments, CAST(sum(CASE WHEN l2 < 1000000 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN n2 IS NOT NULL AND cr <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS corners,
CAST(sum(CASE WHEN n2 IS NOT NULL AND dot > 0 AND 4 * cr * cr < dot * dot AND (l2 < 4000000 OR n2 < 4000000) THEN 1 ELSE 0 END) AS BIGINT) AS small_kinks FROM q GROUP BY line""")
def kink_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line: short segments, corners, and small kinks next to a short segment (slopes as ratios)."""
    l2, n2 = F.expr("(x - px) * (x - px) + (y - py) * (y - py)"), F.expr("(nx - x) * (nx - x) + (ny - y) * (ny - y)")
    q = turns(spark, sf_dir).where("px is not null").select("line", l2.alias("l2"), n2.alias("n2"), F.expr(DOT).alias("dot"), F.expr(CROSS).alias("cr"))
    n = lambda c: F.count_if(F.expr(c))
    return q.groupBy("line").agg(F.count("*").alias("segments"), n("l2 < 1000000").alias("short"), n("n2 is not null and cr <> 0").alias("corners"), n("n2 is not null and dot > 0 and 4 * cr * cr < dot * dot and (l2 < 4000000 or n2 < 4000000)").alias("small_kinks"))


@register("root_stations", "WITH l AS (SELECT o_orderkey AS line, 10 + (o_orderkey * 37) % 400 AS length FROM orders), s AS (SELECT line, length, unnest(range(0, length + 1, 25)) AS s FROM l), b AS (SELECT line, s FROM s UNION SELECT line, length - s FROM s) SELECT line, s, CAST(row_number() OVER (PARTITION BY line ORDER BY s) AS INTEGER) AS n FROM b")
def root_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations every 25 m from both ends of a line."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (10 + (F.col("o_orderkey") * 37) % 400).alias("length"))
    way = F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(25).cast("long"))
    both = F.array_sort(F.array_union(way, F.transform(way, lambda s: F.col("length") - s)))
    return lines.select("line", F.posexplode(both).alias("_n", "s")).select("line", "s", (F.col("_n") + 1).alias("n"))


BALLS = "balls AS (SELECT user_id AS line, event_id % 500 AS s, event_id % 4 AS r, CASE WHEN event_id % 3 > 0 THEN 100 + event_id % 300 END AS low, CASE WHEN event_id % 3 = 0 THEN 220 + event_id % 400 END AS high FROM events)"


@register("depth_envelope", f"""WITH {BALLS}, x AS (SELECT DISTINCT user_id AS line, (event_id * 7) % 500 AS s FROM events),
e AS (SELECT x.line, x.s, greatest(70, coalesce(max(b.low - greatest(0, abs(x.s - b.s) - b.r)), 70)) AS lower, min(b.high + greatest(0, abs(x.s - b.s) - b.r)) AS upper FROM x LEFT JOIN balls b ON b.line = x.line GROUP BY x.line, x.s)
SELECT line, s, lower, upper, least(greatest(150, lower), coalesce(upper, 100000)) AS depth, coalesce(lower > upper, FALSE) AS infeasible FROM e""")
def depth_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth (cm) at every station: no less than the cover and what crossings below ask for, no more than those
    above allow, both less strict by 1 cm a metre of the way to them."""
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    balls = e.select(
        F.col("user_id").alias("line"), (id_ % 500).alias("s"), (id_ % 4).alias("r"),
        F.when(id_ % 3 > 0, 100 + id_ % 300).alias("low"), F.when(id_ % 3 == 0, 220 + id_ % 400).alias("high"),
    )
    x = e.select(F.col("user_id").alias("line"), ((id_ * 7) % 500).alias("s")).distinct()
    return depth.envelope(x, balls, normal=150, cover=70, slope=1)


@register("depth_rules", """WITH d AS (SELECT user_id AS line, event_id, 80 + event_id % 300 AS depth, event_id % 1000 AS s, lag(event_id % 1000) OVER w AS ps, lag(80 + event_id % 300) OVER w AS pd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT line, event_id, depth < 100 AS too_shallow, coalesce(abs(depth - pd) * 10 > abs(s - ps) * 100, FALSE) AS too_steep FROM d WHERE depth < 100 OR coalesce(abs(depth - pd) * 10 > abs(s - ps) * 100, FALSE)""")
def depth_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a profile (cm over m): too little cover, or a slope of more than one in ten."""
    w = Window.partitionBy("line").orderBy("event_id")
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), "event_id", (80 + F.col("event_id") % 300).alias("depth"), (F.col("event_id") % 1000).alias("s"))
    d = d.withColumns({"ps": F.lag("s").over(w), "pd": F.lag("depth").over(w)})
    d = d.withColumns({"too_shallow": F.col("depth") < 100, "too_steep": F.coalesce(F.expr("abs(depth - pd) * 10 > abs(s - ps) * 100"), F.lit(False))})
    return d.where("too_shallow or too_steep").select("line", "event_id", "too_shallow", "too_steep")


@register("depth_factor", "SELECT event_id, CAST(10000 + 5 * (greatest(0, event_id % 500 - 300) + greatest(0, (event_id * 7) % 500 - 300)) AS BIGINT) AS factor FROM events")
def depth_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surcharge of depths beyond 3 m at both ends, in parts of ten thousand."""
    e = F.col("event_id")
    over = lambda x: F.greatest(F.lit(0), x - 300)
    return table(spark, sf_dir, "events").select("event_id", (10000 + 5 * (over(e % 500) + over((e * 7) % 500))).cast("long").alias("factor"))


@register("turn_premium", f"WITH {VERTICES}, {TURNS} SELECT line, event_id, NOT ({CROSS} = 0 OR {DOT} = 0 OR abs({CROSS}) = abs({DOT})) AS premium FROM turns WHERE px IS NOT NULL AND nx IS NOT NULL")
def turn_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners whose angle is none of 0, 45, 90 (and 135, 180) degrees cost more."""
    return turns(spark, sf_dir).where("px is not null and nx is not null").select("line", "event_id", (~F.expr(f"{CROSS} = 0 or {DOT} = 0 or abs({CROSS}) = abs({DOT})")).alias("premium"))


@register("thinned_lines")
def thinned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polylines of users without the corners that lie within 1500 m of what is left."""
    return lines.thin(vertices(spark, sf_dir).withColumnRenamed("event_id", "seq"), 1500.0)
