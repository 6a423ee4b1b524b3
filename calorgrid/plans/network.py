"""Queries of the network graph, of depths along pipes, and of shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.functions import batches, catalog, geometry
from calorgrid.operators import depth, network, sizing, spatial
from calorgrid.operators.lineage import cut
from calorgrid.plans.plane import BOXES, SEGMENT, SEGMENTS, boxes, points, segments
from calorgrid.plans.tables import DEEP, deep, table
from calorgrid.queries import register
from calorgrid.sources import geojson, write

SIZE_DN = "CASE WHEN size % 4 = 0 THEN 0 ELSE size * 10 END"


def _tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deep(spark, sf_dir).where("parent is not null").select(F.col("parent").alias("a"), F.col("node").alias("b"))


@register("eligible_chambers", f"WITH {DEEP}, r AS (SELECT node, count(*) AS rays FROM (SELECT node FROM deep WHERE parent IS NOT NULL UNION ALL SELECT parent FROM deep WHERE parent IS NOT NULL) GROUP BY node) SELECT d.node, CAST({SIZE_DN} AS BIGINT) AS dn, r.rays FROM deep d JOIN r ON r.node = d.node WHERE r.rays < 4 AND {SIZE_DN} > 0")
def eligible_chambers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chambers on the network that can take a pipe: fewer than four rays, and a known dn."""
    chambers = deep(spark, sf_dir).select("node", F.expr(SIZE_DN).cast("long").alias("dn"))
    return network.eligible(chambers, _tree_edges(spark, sf_dir)).select("node", "dn", "rays")


@register("leaf_nodes", f"WITH {DEEP} SELECT node FROM deep WHERE parent IS NOT NULL AND node NOT IN (SELECT parent FROM deep WHERE parent IS NOT NULL)")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.leaves(_tree_edges(spark, sf_dir))


@register("component_stats", """WITH k AS (SELECT p_partkey AS k FROM part), e AS (SELECT k - 1 AS a, k AS b FROM k WHERE k % 6 <> 0 UNION ALL SELECT k - k % 6, k FROM k WHERE k % 18 = 5),
n AS (SELECT DISTINCT x AS node FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)),
c AS (SELECT node // 6 AS c, count(*) AS nodes, sum(CASE WHEN node % 4 = 0 THEN 1 ELSE 0 END) AS sources FROM n GROUP BY node // 6), m AS (SELECT a // 6 AS c, count(*) AS edges FROM e GROUP BY a // 6)
SELECT c.c * 6 AS label, c.nodes, m.edges, CAST(c.sources AS BIGINT) AS sources, m.edges <> c.nodes - 1 OR c.sources <> 1 AS ambiguous FROM c JOIN m ON m.c = c.c""")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of six nodes, some closed to rings: nodes, edges and sources of each, and whether it is ambiguous."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    chain = k.where("k % 6 <> 0").select((F.col("k") - 1).alias("a"), F.col("k").alias("b"))
    ring = k.where("k % 18 = 5").select((F.col("k") - F.col("k") % 6).alias("a"), F.col("k").alias("b"))
    return network.components(chain.union(ring), k.where("k % 4 = 0").select(F.col("k").alias("node")))


@register("breadth_depths", f"""WITH RECURSIVE {DEEP}, e AS (SELECT parent AS a, node AS b FROM deep WHERE parent IS NOT NULL UNION ALL SELECT node, node + 1 FROM deep WHERE node % 5 = 0 AND node + 1 IN (SELECT node FROM deep)), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s AS (SELECT node, 0 AS d FROM deep WHERE node = 0 OR node % 97 = 50 UNION SELECT w.b, s.d + 1 FROM s JOIN ways w ON w.a = s.node WHERE s.d < 16), m AS (SELECT node, min(d) AS depth FROM s GROUP BY node)
SELECT m.node, m.depth, (SELECT min(b.b) FROM ways b JOIN m n ON n.node = b.b WHERE b.a = m.node AND n.depth = m.depth - 1) AS parent FROM m""")
def breadth_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from the nearest of several sources in a network with rings, and the neighbour that leads there."""
    k, nodes = F.col("node"), deep(spark, sf_dir)
    on = nodes.where("node % 5 = 0").select(k.alias("a"), (k + 1).alias("b")).join(nodes.select(k.alias("b")), "b", "left_semi").select("a", "b")
    return network.depths(_tree_edges(spark, sf_dir).union(on), nodes.where("node = 0 or node % 97 = 50").select("node"))


MARKS = """lines AS (SELECT o_orderkey AS line, 100.0::DOUBLE + o_orderkey % 900 AS length FROM orders),
marks AS (SELECT l_orderkey AS line, CAST(l_partkey % 1100 AS DOUBLE) AS s, 'm' || (l_suppkey % 50) AS node FROM lineitem),
ends AS (SELECT line, 0.0::DOUBLE AS s, NULL AS node FROM lines UNION ALL SELECT line, length, NULL FROM lines UNION ALL SELECT m.line, m.s, m.node FROM marks m JOIN lines l ON l.line = m.line WHERE m.s <= l.length),
nodes AS (SELECT line, s, max(node) AS node FROM ends GROUP BY line, s), named AS (SELECT line, s, coalesce(node, line || '@' || s) AS node FROM nodes),
edges AS (SELECT * FROM (SELECT line, s AS a, lead(s) OVER w AS b, node AS u, lead(node) OVER w AS v FROM named WINDOW w AS (PARTITION BY line ORDER BY s)) WHERE b IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (F.lit(100.0) + F.col("o_orderkey") % 900).alias("length"))
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_partkey") % 1100).cast("double").alias("s"), F.concat(F.lit("m"), F.col("l_suppkey") % 50).alias("node"))
    return network.edges_at(lines, marks)


@register("edge_split", f"WITH {MARKS} SELECT line, a, b, u, v FROM edges")
def edge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut into edges at the stations of their marks."""
    return _edges(spark, sf_dir)


@register("edge_at", f"WITH {MARKS}, p AS (SELECT DISTINCT l_orderkey AS line, CAST(l_suppkey * 7 % 1000 AS DOUBLE) AS s FROM lineitem) SELECT line, s, a, b, u, v FROM (SELECT p.line, p.s, e.a, e.b, e.u, e.v, row_number() OVER (PARTITION BY p.line, p.s ORDER BY e.a) AS rn FROM p JOIN edges e ON e.line = p.line AND p.s BETWEEN e.a AND e.b) WHERE rn = 1")
def edge_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge at each of many stations."""
    probes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_suppkey") * 7 % 1000).cast("double").alias("s"))
    return network.edge_of(_edges(spark, sf_dir), probes)


@register("run_chains", "SELECT p_partkey AS line, p_partkey // 4 * 4 AS run FROM part")
def run_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that technical nodes join into runs of four."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    technical = parts.where(k % 4 != 0).select(F.concat(F.lit("n"), k).alias("node"))
    return network.runs(parts.select(k.alias("line"), F.concat(F.lit("n"), k).alias("u"), F.concat(F.lit("n"), k + 1).alias("v")), technical)


@register("prune_tree")
def prune_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep tree without branches that serve nobody and without nodes in the middle of a way."""
    return network.prune(deep(spark, sf_dir).select("node", "parent", F.when(F.col("node") % 50 == 7, F.col("size")).otherwise(0).alias("demand")))


@register("snap_nodes")
def snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of points that lie within 0.1 m of each other, in order."""
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(F.lit("all").alias("scene_id"), k.alias("k"), ((k * 7919) % 997 / 20).alias("x"), ((k * 104729) % 13 / 25).alias("y"), F.lit(None).cast("string").alias("anchor"))
    return network.snap_points(at)


@register("propagate_dn")
def propagate_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters of lines that state none, from the lines whose ends lie within 60 m of theirs."""
    s = segments(spark, sf_dir)
    shapes = cut(s.groupBy(*SEGMENT).agg(F.min("seg").alias("like")))  # equal lines touch each other and the same others
    pairs = spatial.pairs_of_lines(shapes, list(SEGMENT), 60, lambda *quad: batches.ends_within(*quad, 60), "touch boolean", ["like"]).where("touch")
    both = pairs.select(F.explode(F.array(F.struct(F.col("like").alias("a"), F.col("o_like").alias("b")), F.struct(F.col("o_like").alias("a"), F.col("like").alias("b")))).alias("p")).select("p.*")
    dn = F.when(F.col("seg") % 5 == 0, F.element_at(F.array(*[F.lit(p[0]) for p in catalog.PIPES]), (F.col("seg") % 18 + 1).cast("int")))
    lines = s.join(shapes.hint("merge"), list(SEGMENT)).select(F.col("seg").alias("id"), "like", dn.alias("dn"))
    return sizing.propagate_dn(lines, both)


@register("near_chamber", """WITH p AS (SELECT c_custkey AS point, CAST(c_custkey % 41 AS DOUBLE) / 2 AS d FROM customer) SELECT point, d <= 10 + 0.000001 AS inclusive, d < 10 - 0.000001 AS exclusive FROM p""")
def near_chamber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a distance is near, by either form of the rule."""
    d = (F.col("c_custkey") % 41).cast("double") / 2
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), (d <= 10 + 1e-6).alias("inclusive"), (d < 10 - 1e-6).alias("exclusive"))


@register("root_banned", "WITH r AS (SELECT s_suppkey AS root, (s_suppkey * 7919) % 5000 AS x, (s_suppkey * 104729) % 5000 AS y FROM supplier), b AS (SELECT (c_custkey * 7919) % 5000 + c_custkey % 23 - 11 AS x, (c_custkey * 104729) % 5000 + c_custkey % 19 - 9 AS y FROM customer WHERE c_custkey % 50 = 0) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.x - r.x) * (b.x - r.x) + (b.y - r.y) * (b.y - r.y) <= 40000)")
def root_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that no banned point is within 200 m of."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("root"), ((k * 7919) % 5000).alias("rx"), ((k * 104729) % 5000).alias("ry"))
    banned = points(spark, sf_dir).where("point % 50 = 0")
    at = tuple(F.col(c) + m for c, m in (("x", -200), ("y", -200), ("x", 200), ("y", 200)))
    near = spatial.near(banned, r, at, tuple(F.col(c) for c in ("rx", "ry", "rx", "ry")), 200).where("(x - rx) * (x - rx) + (y - ry) * (y - ry) <= 40000")
    return r.select("root").join(near.select("root"), "root", "left_anti")


@register("ring_crossings", """WITH v AS (SELECT user_id AS line, event_id, (event_id * 7919) % 500 AS ax, (event_id * 104729) % 500 AS ay FROM events), t AS (SELECT line, ax, ay, row_number() OVER w AS seq, lead(ax) OVER w AS bx, lead(ay) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY line ORDER BY event_id)), s AS (SELECT * FROM t WHERE bx IS NOT NULL)
SELECT a.line, CAST(a.seq AS INTEGER) AS seq, CAST(b.seq AS INTEGER) AS other FROM s a JOIN s b ON a.line = b.line AND a.seq + 1 < b.seq WHERE sign((a.bx - a.ax) * (b.ay - a.ay) - (a.by_ - a.ay) * (b.ax - a.ax)) * sign((a.bx - a.ax) * (b.by_ - a.ay) - (a.by_ - a.ay) * (b.bx - a.ax)) < 0
AND sign((b.bx - b.ax) * (a.ay - b.ay) - (b.by_ - b.ay) * (a.ax - b.ax)) * sign((b.bx - b.ax) * (a.by_ - b.ay) - (b.by_ - b.ay) * (a.bx - b.ax)) < 0""")
def ring_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of one line that cross, neighbours left out: the line is not simple."""
    from pyspark.sql import Window

    e, w = F.col("event_id"), Window.partitionBy("line").orderBy("event_id")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), "event_id", ((e * 7919) % 500).alias("ax"), ((e * 104729) % 500).alias("ay"))
    s = v.select("line", F.row_number().over(w).alias("seq"), "ax", "ay", F.lead("ax").over(w).alias("bx"), F.lead("ay").over(w).alias("by_")).where("bx is not null")
    s = spatial.own_cells(s, ("ax", "ay", "bx", "by_"))
    o = s.select("line", "_cell", *[F.col(c).alias(f"o_{c}") for c in ("seq", "ax", "ay", "bx", "by_")])
    box = lambda a, b, c, d: (F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))
    pairs = spatial.near(s, o, box("ax", "ay", "bx", "by_"), box("o_ax", "o_ay", "o_bx", "o_by_"), F.col("_cell"), ["line", "_cell"]).where("seq + 1 < o_seq")
    p = lambda x, y: (F.col(x), F.col(y))
    hit = geometry.crosses(p("ax", "ay"), p("bx", "by_"), p("o_ax", "o_ay"), p("o_bx", "o_by_"))
    return pairs.where(hit).select("line", "seq", F.col("o_seq").alias("other"))


@register("ring_area", f"WITH {BOXES}, h AS (SELECT *, (x2 - x1) // 4 AS h FROM boxes) SELECT box, (x2 - x1) * (y2 - y1) - (x2 - x1 - 2 * h) * (y2 - y1 - 2 * h) AS area, 2 * (x2 - x1 + y2 - y1) + 2 * (x2 - x1 + y2 - y1 - 4 * h) AS length, CAST(8 AS INTEGER) AS corners FROM h")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, length and corners of boxes with a hole, from their rings: half the sum of cross products, holes less."""
    ring = "array({0}, {1}, {2}, {3}, {0})"
    corner = lambda m: [f"struct(x1 + {m} AS x, y1 + {m} AS y)", f"struct(x2 - {m} AS x, y1 + {m} AS y)", f"struct(x2 - {m} AS x, y2 - {m} AS y)", f"struct(x1 + {m} AS x, y2 - {m} AS y)"]
    b = boxes(spark, sf_dir).withColumn("h", F.floor((F.col("x2") - F.col("x1")) / 4).cast("long"))
    sides = "transform(sequence(1, 4), i -> struct(r[i - 1].x AS ax, r[i - 1].y AS ay, r[i].x AS bx, r[i].y AS by))"
    rings = b.select("box", F.posexplode(F.expr(f"array({ring.format(*corner('0'))}, {ring.format(*corner('h'))})")).alias("n", "r")).select("box", "n", F.explode(F.expr(sides)).alias("s")).select("box", "n", "s.*")
    one = rings.groupBy("box", "n").agg(F.abs(F.sum(F.expr("ax * by - ay * bx"))).alias("twice"), F.sum(F.expr("abs(bx - ax) + abs(by - ay)")).alias("length"), F.count("*").alias("corners"))
    return one.groupBy("box").agg(F.expr("sum(if(n = 0, twice, -twice)) div 2").alias("area"), F.sum("length").alias("length"), F.sum("corners").cast("int").alias("corners"))


@register("shape_keys", f"""WITH {SEGMENTS} SELECT seg, printf('%.12f,%.12f', ax / 7.0::DOUBLE, ay / 7.0::DOUBLE) AS key,
sha256(least(ax || ' ' || ay || ',' || bx || ' ' || by_, bx || ' ' || by_ || ',' || ax || ' ' || ay)) AS fingerprint FROM segments""")
def shape_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text key of a point, and a hash of a line that doesn't depend on its direction."""
    s = segments(spark, sf_dir)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = F.array(F.array(point("ax", "ay"), point("bx", "by_")))
    return s.select("seg", F.format_string("%.12f,%.12f", F.col("ax") / F.lit(7.0), F.col("ay") / F.lit(7.0)).alias("key"), geojson.fingerprint(rings, 0).alias("fingerprint"))


@register("number_text", "SELECT c_custkey, replace(replace(replace(format('{:,.2f}', abs(c_acctbal) * 1000), ',', ' '), '.', ','), '_', '') AS amount FROM customer")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as reports show them."""
    return table(spark, sf_dir, "customer").select("c_custkey", write.spaced(F.abs("c_acctbal") * 1000).alias("amount"))


@register("decimal_parse", "WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || '.50 ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN '-' || p_size ELSE CAST(p_size AS VARCHAR) END AS said FROM part) SELECT p_partkey, TRY_CAST(trim(said) AS DECIMAL(18,6)) AS value, coalesce(TRY_CAST(trim(said) AS DECIMAL(18,6)) >= 0, FALSE) AS valid FROM t")
def decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from text, and which are sound flows."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit(" "), size, F.lit(".50 "))).when(k == 1, "n/a").when(k == 2, "").when(k == 3, F.concat(F.lit("-"), size)).otherwise(size)
    value = F.trim(said).try_cast("decimal(18,6)")
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("value"), F.coalesce(value >= 0, F.lit(False)).alias("valid"))


RAMP = "CASE WHEN (a - 3) * (b - 3) < 0 THEN l * ((3 - a) / (b - a)) * (1 + 0.1::DOUBLE * greatest(0, a - 3) + 1) / 2 + l * (1 - (3 - a) / (b - a)) * (1 + (1 + 0.1::DOUBLE * greatest(0, b - 3))) / 2 ELSE l * ((1 + 0.1::DOUBLE * greatest(0, a - 3)) + (1 + 0.1::DOUBLE * greatest(0, b - 3))) / 2 END"


@register("ramp_cost", f"WITH r AS (SELECT event_id, 10 + (event_id % 90)::DOUBLE AS l, 0.5::DOUBLE + (event_id % 17)::DOUBLE / 4 AS a, 0.5::DOUBLE + (event_id % 19)::DOUBLE / 4 AS b FROM events) SELECT event_id, CASE WHEN least(a, b) >= 0.7 AND abs(b - a) <= 0.1::DOUBLE * l + 0.000000001 THEN CAST(round(CAST({RAMP} AS DECIMAL(28,9)) * 89748, 2) AS DECIMAL(20,2)) END AS cost FROM r")
def ramp_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of ramps of DN100 between two depths."""
    e = F.col("event_id")
    l, a, b = 10 + (e % 90).cast("double"), 0.5 + (e % 17).cast("double") / 4, 0.5 + (e % 19).cast("double") / 4
    return table(spark, sf_dir, "events").select("event_id", depth.ramp_cost(l, F.lit("89748").cast("decimal(12,2)"), a, b).cast("decimal(20,2)").alias("cost"))


@register("depth_cost", "SELECT user_id, CAST(sum(CAST((event_id % 40 + 1) * 89748 * 5 * (greatest(0, event_id % 70 - 30) + greatest(0, event_id % 50 - 30)) AS DECIMAL(28,0))) / 1000 AS DECIMAL(28,2)) AS extra FROM events GROUP BY user_id")
def depth_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depths beyond 3 m add to the price of each user's pipes (depths in tenths of a metre)."""
    e = F.col("event_id")
    over = F.greatest(F.lit(0), e % 70 - 30) + F.greatest(F.lit(0), e % 50 - 30)
    extra = F.sum(((e % 40 + 1) * 89748 * 5 * over).cast("decimal(28,0)"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((extra / 1000).cast("decimal(28,2)").alias("extra"))


@register("depth_split", """WITH p AS (SELECT DISTINCT user_id AS line, CAST(event_id % 400 AS DOUBLE) AS s, 1 + (event_id % 400 * 7 % 17)::DOUBLE / 4 AS h FROM events), n AS (SELECT *, lag(s) OVER w AS s0, lag(h) OVER w AS h0, lead(s) OVER w AS s2, lead(h) OVER w AS h2 FROM p WINDOW w AS (PARTITION BY line ORDER BY s))
SELECT line, s, h FROM n WHERE s0 IS NULL OR s2 IS NULL OR h = 3 OR abs((h - h0) * (s2 - s) - (h2 - h) * (s - s0)) > 0.000000001 UNION ALL SELECT line, s + (3 - h) * (s2 - s) / (h2 - h), 3 FROM n WHERE (h - 3) * (h2 - 3) < 0""")
def depth_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break points of depth profiles, those at 3 m added and straight ones left out."""
    e = F.col("event_id")
    profile = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), (e % 400).cast("double").alias("s"), (1 + (e % 400 * 7 % 17).cast("double") / 4).alias("h")).distinct()
    return depth.split(profile)


@register("crossing_bounds", """WITH c AS (SELECT event_id, 0.2::DOUBLE + (event_id % 9)::DOUBLE / 10 AS sine, (event_id % 5)::DOUBLE AS width, 0.5::DOUBLE + (event_id % 12)::DOUBLE / 4 AS depth, event_id % 4 = 0 AS road FROM events)
SELECT event_id, round((width / 2 + 1) / sine, 9) AS radius, round(depth + 0.2, 9) AS below, CASE WHEN NOT road AND depth - 0.2::DOUBLE - 0.51::DOUBLE >= 0.7 THEN round(depth - 0.2::DOUBLE - 0.51::DOUBLE, 9) END AS above FROM c""")
def crossing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crossed object asks of the depth, and along how much of the pipe."""
    e = F.col("event_id")
    num = lambda m, by, plus=0.0: plus + (e % m).cast("double") / by
    radius, below, above = depth.bounds(num(9, 10, 0.2), (e % 5).cast("double"), num(12, 4, 0.5), 0.51, e % 4 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(radius, 9).alias("radius"), F.round(below, 9).alias("below"), F.round(above, 9).alias("above"))


TREE = f"""{DEEP}, edges AS (SELECT node AS edge, parent, 5 + (node * 37) % 200 AS length FROM deep WHERE parent IS NOT NULL),
balls AS (SELECT edge, (edge * 31) % (length + 1) AS s, (edge * 17) % 90 AS r, CASE WHEN edge % 3 > 0 THEN 100 + (edge * 7) % 900 END AS low, CASE WHEN edge % 3 = 0 THEN 420 + (edge * 11) % 900 END AS high FROM edges),
probes AS (SELECT edge, unnest([0, length // 2, length]) AS s FROM edges)"""


@register("tree_depths", f"""WITH RECURSIVE {TREE}, up AS (SELECT edge, parent AS at, 0 AS way FROM edges UNION ALL SELECT up.edge, e.parent, up.way + e.length FROM up JOIN edges e ON e.edge = up.at),
b AS (SELECT b.*, u.at, b.s + u.way AS way FROM balls b JOIN up u ON u.edge = b.edge UNION ALL SELECT b.*, b.edge, e.length - b.s FROM balls b JOIN edges e ON e.edge = b.edge),
p AS (SELECT p.*, u.at, p.s + u.way AS way FROM probes p JOIN up u ON u.edge = p.edge UNION ALL SELECT p.*, p.edge, e.length - p.s FROM probes p JOIN edges e ON e.edge = p.edge),
d AS (SELECT p.edge, p.s, p.way + b.way - b.r AS d, b.low, b.high FROM p JOIN b ON b.at = p.at UNION ALL SELECT p.edge, p.s, abs(p.s - b.s) - b.r, b.low, b.high FROM probes p JOIN balls b ON b.edge = p.edge),
e AS (SELECT edge, s, greatest(70, coalesce(max(low - 10 * greatest(0, d)), 70)) AS lower, min(high + 10 * greatest(0, d)) AS upper FROM d GROUP BY edge, s)
SELECT edge, CAST(s AS BIGINT) AS s, CAST(lower AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper, CAST(least(greatest(300, lower), upper) AS BIGINT) AS depth, coalesce(lower > upper, FALSE) AS infeasible FROM e""")
def tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth (cm) at both ends and in the middle of every edge of the deep tree, which each edge's crossed object
    bounds from above or below along all ways, by 10 cm a metre less strictly."""
    k, length = F.col("node"), F.expr("5 + (node * 37) % 200")
    nodes = deep(spark, sf_dir).select(k, "parent", length.alias("length"))
    edges = nodes.where("parent is not null")
    balls = edges.select(k.alias("edge"), ((k * 31) % (F.col("length") + 1)).alias("s"), ((k * 17) % 90).alias("r"), F.when(k % 3 > 0, 100 + (k * 7) % 900).alias("low"), F.when(k % 3 == 0, 420 + (k * 11) % 900).alias("high"))
    probes = edges.select(k.alias("edge"), F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.expr("length div 2"), "length"))).alias("s"))
    whole = [F.col(c).cast("long").alias(c) for c in ("s", "lower", "upper", "depth")]
    return depth.tree_envelope(nodes, balls, probes, normal=300, cover=70, slope=10).select("edge", *whole, "infeasible")


@register("side_choice", """WITH RECURSIVE x AS (SELECT l_orderkey AS scene, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_partkey % 7 AS over_cost, l_suppkey % 7 AS under_cost, l_partkey % 3 AS over_depth, 3 + l_suppkey % 3 AS under_depth FROM lineitem),
m AS (SELECT scene, n, 0 AS mask, over_cost AS cost, over_depth AS low, over_depth AS high FROM x WHERE n = 0 UNION ALL SELECT scene, n, 1, under_cost, under_depth, under_depth FROM x WHERE n = 0
UNION ALL SELECT m.scene, x.n, m.mask + CAST(s.s * power(2, x.n) AS BIGINT), m.cost + CASE s.s WHEN 0 THEN x.over_cost ELSE x.under_cost END, least(m.low, CASE s.s WHEN 0 THEN x.over_depth ELSE x.under_depth END), greatest(m.high, CASE s.s WHEN 0 THEN x.over_depth ELSE x.under_depth END) FROM m JOIN x ON x.scene = m.scene AND x.n = m.n + 1 CROSS JOIN (VALUES (0), (1)) s(s) WHERE x.n < 8),
l AS (SELECT scene, least(max(n), 7) AS n FROM x GROUP BY scene), r AS (SELECT m.scene, m.mask, m.cost, row_number() OVER (PARTITION BY m.scene ORDER BY bit_count(CAST(m.mask AS BIGINT)), m.cost, m.mask) AS rn FROM m JOIN l ON l.scene = m.scene AND l.n = m.n WHERE m.high - m.low <= 3)
SELECT scene, CAST(mask AS BIGINT) AS mask, CAST(cost AS BIGINT) AS cost FROM r WHERE rn = 1""")
def side_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above or below each of up to eight crossings: of all choices whose depths lie within 3 m, the one with the
    fewest passed below, then the cheapest. The choices of a scene are at most 256 rows."""
    from pyspark.sql import Window

    order = Window.partitionBy("scene").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("scene", F.col("l_orderkey")).withColumn("n", F.row_number().over(order) - 1).where("n < 8")
    side = lambda cost, at: F.struct(cost.alias("cost"), at.alias("at"))
    x = rows.select("scene", "n", side(F.col("l_partkey") % 7, F.col("l_partkey") % 3).alias("over"), side(F.col("l_suppkey") % 7, 3 + F.col("l_suppkey") % 3).alias("under"))
    all_ = x.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("n", "over", "under"))).alias("c"))  # at most eight
    masks = F.explode(F.expr("sequence(0L, shiftleft(1L, size(c)) - 1)")).alias("mask")
    taken = F.expr("transform(c, (e, i) -> if((shiftright(mask, i) & 1) = 1, e.under, e.over))")
    tried = all_.select("scene", "c", masks).withColumn("t", taken)
    tried = tried.select("scene", "mask", F.expr("aggregate(t, 0L, (a, e) -> a + e.cost)").alias("cost"), F.expr("array_max(transform(t, e -> e.at)) - array_min(transform(t, e -> e.at))").alias("span")).where("span <= 3")
    best = tried.groupBy("scene").agg(F.min(F.struct(F.bit_count("mask").alias("under"), "cost", "mask")).alias("b"))
    return best.select("scene", "b.mask", "b.cost")
