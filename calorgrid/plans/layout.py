"""Sizing, pricing and ranking of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from calorgrid.functions import catalog, pricing
from calorgrid.operators import graph, network, sizing, tours, tree
from calorgrid.plans.tables import DEEP, FLOWS, deep, flows, length_of, table
from calorgrid.queries import register

C = catalog.VALUES_SQL
LENGTH = "CAST(5 + ({} * 37) % 200 AS DECIMAL(18,9))"
CHAMBER = "CASE WHEN {0} <= 200 THEN 3000000 WHEN {0} <= 500 THEN 5000000 WHEN {0} <= 1000 THEN 8000000 ELSE 12000000 END"


@register("catalog_bracket", f"WITH {FLOWS} SELECT custkey, flow, (SELECT min(dn) FROM {C} WHERE capacity >= flow) AS dn FROM flows")
def catalog_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("custkey", "flow", catalog.base_dn(F.col("flow")).alias("dn"))


@register("catalog_boundaries", f"""WITH c AS (SELECT dn, capacity, row_number() OVER (ORDER BY dn) - 1 AS n FROM (SELECT * FROM {C})),
p AS (SELECT c_custkey, c.dn AS of_dn, CAST(c.capacity + (c_custkey // 18 % 3 - 1) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS flow FROM customer JOIN c ON c.n = c_custkey % 18)
SELECT c_custkey, of_dn, flow, (SELECT min(dn) FROM {C} WHERE capacity >= flow) AS dn, CAST({CHAMBER.format('of_dn')} AS INTEGER) AS chamber FROM p""")
def catalog_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipe and the chamber's price for flows at, just below and just above what a pipe of the catalogue carries."""
    k = F.col("c_custkey")
    row = lambda column, kind: F.element_at(F.array(*[F.lit(p[column]).cast(kind) for p in sorted(catalog.PIPES)]), (k % 18 + 1).cast("int"))
    shift = (F.floor(k / 18) % 3 - 1).cast("decimal(4,0)") * F.lit("0.01").cast("decimal(4,2)")
    p = table(spark, sf_dir, "customer").select("c_custkey", row(0, "int").alias("of_dn"), (row(1, "decimal(12,2)") + shift).cast("decimal(12,2)").alias("flow"))
    return p.select("c_custkey", "of_dn", "flow", catalog.base_dn(F.col("flow")).alias("dn"), catalog.chamber_price(F.col("of_dn")).alias("chamber"))


@register("dn_normalise", f"WITH p AS (SELECT p_partkey, p_size * 37 AS said FROM part) SELECT p_partkey, said, coalesce((SELECT min(dn) FROM {C} WHERE dn >= said), 1400) AS dn, coalesce((SELECT min(dn) FROM {C} WHERE dn >= said), 1400) <> said AS changed FROM p")
def dn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("said")).withColumn("dn", catalog.at_least_dn(F.col("said")))
    return p.withColumn("changed", F.col("dn") != F.col("said"))


@register("chamber_price", f"WITH {FLOWS}, d AS (SELECT nationkey, (SELECT min(dn) FROM {C} WHERE capacity >= flow) AS dn FROM flows WHERE connected) SELECT nationkey, max(dn) AS dn, CAST({CHAMBER.format('max(dn)')} AS INTEGER) AS price FROM d GROUP BY nationkey")
def chamber_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flows(spark, sf_dir).where("connected").groupBy("nationkey").agg(F.max(catalog.base_dn(F.col("flow"))).alias("dn"))
    return d.withColumn("price", catalog.chamber_price(F.col("dn")))


KIND = "['road', 'tram_tracks', 'gas_pipeline', 'power_cable', 'heat_network', 'park'][CAST({} % 6 AS INTEGER) + 1]"


def kinds(key):
    return F.element_at(F.array(*[F.lit(k) for k in ("road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network", "park")]), (key % 6 + 1).cast("int"))


def _sized(rows: DataFrame) -> DataFrame:
    """Flows with dn, length, factor k and cost of the pipe of each consumer."""
    f = rows.withColumns({
        "dn": catalog.base_dn(F.col("flow")),
        "length": length_of(F.col("custkey")),
        "k": catalog.crossing_factor(kinds(F.col("custkey"))),
    })
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)")
    return f.withColumn("cost", pricing.piece_cost(F.col("length"), price, F.col("k")))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipes of connected consumers."""
    return _sized(flows(spark, sf_dir).where("connected"))


FACTOR = "CAST(CASE {} WHEN 'road' THEN 1.6 WHEN 'tram_tracks' THEN 1.75 WHEN 'gas_pipeline' THEN 1.25 WHEN 'power_cable' THEN 1.15 WHEN 'heat_network' THEN 1.05 ELSE 1 END AS DECIMAL(4,2))"
PIECES = f"""{FLOWS},
pieces AS (SELECT f.custkey, f.nationkey, f.flow, f.dn, f.length, f.k, CAST(round(CAST(f.length AS DECIMAL(12,3)) * c.new_price * f.k, 2) AS DECIMAL(20,2)) AS cost
  FROM (SELECT *, (SELECT min(dn) FROM {C} WHERE capacity >= flow) AS dn, {LENGTH.format('custkey')} AS length, {FACTOR.format(KIND.format('custkey'))} AS k FROM flows WHERE connected) f
  JOIN (SELECT * FROM {C}) c ON c.dn = f.dn)"""


@register("piece_cost", f"WITH {PIECES} SELECT custkey, dn, length, k, cost FROM pieces")
def piece_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("custkey", "dn", "length", "k", "cost")


@register("penalty_total", f"WITH {FLOWS} SELECT nationkey, count(*) AS missing, CAST(sum(CAST(100000000 + flow * 500000 AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS penalty FROM flows WHERE NOT connected GROUP BY nationkey")
def penalty_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("not connected").groupBy("nationkey").agg(F.count("*").alias("missing"), F.sum(pricing.penalty(F.col("flow"))).cast("decimal(30,2)").alias("penalty"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regionkey, construction, chambers, penalty, cost, length, missing and score of a layout per region."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
    f = _sized(flows(spark, sf_dir))
    on, money = F.col("connected"), "decimal(20,2)"
    by = f.groupBy("nationkey").agg(
        F.sum(F.when(on, F.col("cost"))).cast(money).alias("construction"),
        F.sum(F.when(on, F.col("length"))).cast("decimal(18,9)").alias("length"),
        catalog.chamber_price(F.max(F.when(on, F.col("dn")))).alias("chambers"),
        F.count_if(~on).alias("missing"),
        F.sum(F.when(~on, pricing.penalty(F.col("flow")))).cast(money).alias("penalty"),
    )
    by = by.withColumn("chambers", F.when(F.col("construction").isNotNull(), F.col("chambers")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    r = nations.join(by, "nationkey", "left").groupBy("regionkey").agg(*[F.sum(zero(F.col(c))).cast(t).alias(c) for c, t in (("construction", "decimal(18,2)"), ("chambers", "decimal(18,2)"), ("penalty", "decimal(18,2)"), ("length", "decimal(18,9)"), ("missing", "long"))])
    r = r.withColumn("cost", (F.col("construction") + F.col("chambers") + F.col("penalty")).cast("decimal(18,2)"))
    return r.withColumn("score", pricing.score(F.col("cost"), F.col("length")))


LAYOUTS = f"""{PIECES},
by_nation AS (SELECT nationkey, sum(cost) AS construction, sum(length) AS length, {CHAMBER.format('max(dn)')} AS chambers FROM pieces GROUP BY nationkey),
lost AS (SELECT nationkey, count(*) AS missing, sum(CAST(100000000 + flow * 500000 AS DECIMAL(20,2))) AS penalty FROM flows WHERE NOT connected GROUP BY nationkey),
regions AS (SELECT n.n_regionkey AS regionkey, CAST(sum(coalesce(b.construction, 0)) AS DECIMAL(18,2)) AS construction, CAST(sum(coalesce(b.chambers, 0)) AS DECIMAL(18,2)) AS chambers, CAST(sum(coalesce(l.penalty, 0)) AS DECIMAL(18,2)) AS penalty, CAST(sum(coalesce(b.length, 0)) AS DECIMAL(18,9)) AS length, CAST(sum(coalesce(l.missing, 0)) AS BIGINT) AS missing
  FROM nation n LEFT JOIN by_nation b ON b.nationkey = n.n_nationkey LEFT JOIN lost l ON l.nationkey = n.n_nationkey GROUP BY n.n_regionkey),
layouts AS (SELECT *, CAST(construction + chambers + penalty AS DECIMAL(18,2)) AS cost, CAST(CAST(construction + chambers + penalty AS DECIMAL(18,2)) * CAST(0.000000028 AS DECIMAL(10,9)) + length * CAST(0.003 AS DECIMAL(4,3)) AS DECIMAL(28,12)) AS score FROM regions)"""


@register("objective_score", f"WITH {LAYOUTS} SELECT regionkey, cost, length, score FROM layouts")
def objective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("regionkey", "cost", "length", "score")


@register("variant_ranking", f"WITH {LAYOUTS} SELECT regionkey, missing, score, CAST(row_number() OVER (ORDER BY missing, score, regionkey) AS INTEGER) AS rank FROM layouts")
def variant_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).select("regionkey", "missing", "score", F.row_number().over(Window.orderBy("missing", "score", "regionkey")).alias("rank"))


@register("rank_check", f"WITH {LAYOUTS}, r AS (SELECT regionkey, score, row_number() OVER (ORDER BY missing, score, regionkey) AS rank FROM layouts) SELECT regionkey, CAST(rank AS INTEGER) AS rank, score < lag(score) OVER (ORDER BY rank) AS falls FROM r")
def rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = variant_ranking(spark, sf_dir)
    return r.select("regionkey", "rank", (F.col("score") < F.lag("score").over(Window.orderBy("rank"))).alias("falls"))


@register("legacy_totals", f"WITH {LAYOUTS} SELECT regionkey, kind, CAST(value AS DECIMAL(18,2)) AS value FROM (SELECT regionkey, 'heat_network' AS kind, construction AS value FROM layouts UNION ALL SELECT regionkey, 'heat_chamber', chambers FROM layouts UNION ALL SELECT regionkey, 'penalty', penalty FROM layouts)")
def legacy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(spark, sf_dir).selectExpr("regionkey", "stack(3, 'heat_network', construction, 'heat_chamber', chambers, 'penalty', penalty) AS (kind, value)")


@register("report_totals", f"""WITH {PIECES} SELECT n.n_regionkey AS regionkey, count(*) AS pieces, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS special,
  CAST(sum(CASE WHEN k > 1 THEN cost ELSE 0 END) AS DECIMAL(20,2)) AS special_cost, CAST(sum(CASE WHEN k > 1 THEN 0 ELSE cost END) AS DECIMAL(20,2)) AS base_cost, min(dn) AS least_dn, max(dn) AS largest_dn
  FROM pieces p JOIN nation n ON n.n_nationkey = p.nationkey GROUP BY n.n_regionkey""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
    special = F.col("k") > 1
    return _pieces(spark, sf_dir).join(nations, "nationkey").groupBy("regionkey").agg(F.count("*").alias("pieces"), F.count_if(special).alias("special"), F.sum(F.when(special, F.col("cost")).otherwise(0)).cast("decimal(20,2)").alias("special_cost"), F.sum(F.when(special, 0).otherwise(F.col("cost"))).cast("decimal(20,2)").alias("base_cost"), F.min("dn").alias("least_dn"), F.max("dn").alias("largest_dn"))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = flows(spark, sf_dir).select(F.concat(F.lit("c"), "custkey").alias("node"), F.concat(F.lit("n"), "nationkey").alias("parent"), F.when(F.col("connected"), F.col("flow")).otherwise(0).cast("decimal(18,2)").alias("flow"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit(0).cast("decimal(18,2)").alias("flow"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("decimal(18,2)").alias("flow"))
    return c.union(n).union(r)


FOREST = f"""{FLOWS},
forest AS (SELECT 'c' || custkey AS node, 'n' || nationkey AS parent, CAST(CASE WHEN connected THEN flow ELSE 0 END AS DECIMAL(12,2)) AS flow FROM flows
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(0 AS DECIMAL(12,2)) FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, CAST(0 AS DECIMAL(12,2)) FROM region)"""
CLIMB = "climb AS (SELECT node, parent, node AS above FROM {0} UNION ALL SELECT c.node, t.parent, t.node FROM climb c JOIN {0} t ON t.node = c.parent)"


@register("flow_rollup", f"WITH RECURSIVE {FOREST}, {CLIMB.format('forest')} SELECT c.above AS node, CAST(sum(f.flow) AS DECIMAL(18,2)) AS flow FROM climb c JOIN forest f ON f.node = c.node GROUP BY c.above")
def flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roll_up(_forest(spark, sf_dir), "flow").select("node", F.col("total").cast("decimal(18,2)").alias("flow"))


@register("flow_rollup_deep", f"WITH RECURSIVE {DEEP}, {CLIMB.format('deep')} SELECT c.above AS node, CAST(sum(d.size) AS BIGINT) AS total FROM climb c JOIN deep d ON d.node = c.node GROUP BY c.above")
def flow_rollup_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roll_up(deep(spark, sf_dir), "size").select("node", "total")


DESCEND = "down AS (SELECT node, parent, 0 AS depth FROM deep WHERE parent IS NULL UNION ALL SELECT d.node, d.parent, u.depth + 1 FROM down u JOIN deep d ON d.parent = u.node)"


@register("bfs_depth", f"WITH RECURSIVE {DEEP}, {DESCEND} SELECT node, parent, depth FROM down")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.levels(deep(spark, sf_dir)).select("node", "parent", "depth")


@register("orient_tree", f"WITH RECURSIVE {DEEP}, {DESCEND} SELECT node AS id, parent AS up, node AS down FROM down WHERE parent IS NOT NULL")
def orient_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep tree's edges, given without a direction, turned away from the root by round trips."""
    d = deep(spark, sf_dir).where("parent is not null")
    turned = F.col("node") % 2 == 0
    edges = d.select(F.col("node").alias("id"), F.when(turned, F.col("node")).otherwise(F.col("parent")).alias("a"), F.when(turned, F.col("parent")).otherwise(F.col("node")).alias("b"))
    return tours.orient(edges, deep(spark, sf_dir).where("parent is null").select("node"))


CHORDS = """chords AS (SELECT node AS a, parent AS b FROM deep WHERE parent IS NOT NULL UNION SELECT node, node // 50 FROM deep WHERE node % 7 = 0),
sides AS (SELECT a, b FROM chords UNION SELECT b, a FROM chords), walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN sides ON a = node WHERE depth < 24),
least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


@register("breadth_depths", f"WITH RECURSIVE {DEEP}, {CHORDS} SELECT l.node, l.depth, min(u.node) AS parent FROM least l LEFT JOIN sides ON sides.b = l.node LEFT JOIN least u ON u.node = sides.a AND u.depth = l.depth - 1 GROUP BY l.node, l.depth")
def breadth_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from node 0 over the deep tree and chords of every seventh node."""
    d = deep(spark, sf_dir)
    edges = d.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    edges = edges.union(d.where("node % 7 = 0").select("node", F.floor(F.col("node") / 50).cast("long")))
    return network.depths(edges, d.where("node = 0").select("node"))


def _looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep tree with node 5 put below its own descendant 17: a cycle that no root reaches."""
    return deep(spark, sf_dir).withColumn("parent", F.when(F.col("node") == 5, 17).otherwise(F.col("parent")))


@register("cycle_guard", f"WITH RECURSIVE looped AS (SELECT node, CASE WHEN node = 5 THEN 17 ELSE parent END AS parent FROM ({'SELECT * FROM deep'})), {DEEP}, {DESCEND.replace('deep', 'looped')} SELECT l.node, l.parent FROM looped l LEFT JOIN down d ON d.node = l.node WHERE d.node IS NULL".replace("WITH RECURSIVE looped", f"WITH RECURSIVE {DEEP}, looped").replace(f", {DEEP}, down", ", down"))
def cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_nodes = _looped(spark, sf_dir).select("node", "parent")
    return all_nodes.join(tree.levels(all_nodes).select("node"), "node", "left_anti")


@register("orphan_edges", "WITH e AS (SELECT p_partkey AS node, p_partkey + p_size * 40 AS parent FROM part) SELECT e.node, e.parent FROM e LEFT JOIN part p ON p.p_partkey = e.parent WHERE p.p_partkey IS NULL")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + F.col("p_size") * 40).alias("parent")))


@register("node_degree", f"WITH {DEEP} SELECT node, count(*) AS degree FROM (SELECT node FROM deep WHERE parent IS NOT NULL UNION ALL SELECT parent FROM deep WHERE parent IS NOT NULL) GROUP BY node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.degree(deep(spark, sf_dir))


@register("components", """WITH RECURSIVE e AS (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || CAST((s_suppkey * 7) % 23 AS VARCHAR) AS b FROM supplier UNION SELECT DISTINCT 's' || ((s_suppkey + 5) % 60), 'n' || CAST((s_suppkey * 7) % 23 AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0),
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e), nodes AS (SELECT DISTINCT a AS node FROM v),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, v.b FROM reach r JOIN v ON v.a = r.other)
SELECT node, min(other) AS label FROM reach GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    to = F.concat(F.lit("n"), ((key * 7) % 23).cast("string")).alias("b")
    e = s.select(F.concat(F.lit("s"), key).alias("a"), to).union(s.where(key % 3 == 0).select(F.concat(F.lit("s"), (key + 5) % 60).alias("a"), to)).distinct()
    return graph.components(e, e.select(F.explode(F.array("a", "b")).alias("node")).distinct())


DN_OF = f"(SELECT min(dn) FROM {C} WHERE capacity >= {{}})"


def _level(name: str, edges: str, below: str | None) -> str:
    """SQL of one level of path diameters: edges (edge, parent, flow, length) above those of the CTE `below`."""
    tails = f"(SELECT parent, max(dn) AS least FROM {below} GROUP BY parent)" if below else "(SELECT CAST(NULL AS VARCHAR) AS parent, 0 AS least)"
    tail = f"(SELECT parent, dn, max(tail) AS tail FROM {below} GROUP BY parent, dn)" if below else "(SELECT CAST(NULL AS VARCHAR) AS parent, 0 AS dn, CAST(0 AS DECIMAL(18,9)) AS tail)"
    return f"""{name}_options AS (SELECT e.*, c.dn, CAST(e.length + coalesce(x.tail, 0) AS DECIMAL(18,9)) AS tail, c.max_length FROM {edges} e
  LEFT JOIN {tails} m ON m.parent = e.edge JOIN (SELECT * FROM {C}) c ON c.dn >= greatest(coalesce(m.least, 0), {DN_OF.format('e.flow')}) LEFT JOIN {tail} x ON x.parent = e.edge AND x.dn = c.dn),
{name} AS (SELECT edge, parent, flow, dn, tail FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY dn) AS rn FROM {name}_options WHERE tail <= max_length) WHERE rn = 1)"""


@register("path_diameter", f"""WITH {FLOWS},
c AS (SELECT 'c' || custkey AS edge, 'n' || nationkey AS parent, CAST(CASE WHEN connected THEN flow ELSE 0 END AS DECIMAL(12,2)) AS flow, {LENGTH.format('custkey')} AS length FROM flows),
n AS (SELECT 'n' || n_nationkey AS edge, 'r' || n_regionkey AS parent, CAST(coalesce((SELECT sum(flow) FROM c WHERE c.parent = 'n' || n_nationkey), 0) AS DECIMAL(12,2)) AS flow, {LENGTH.format('n_nationkey')} AS length FROM nation),
r AS (SELECT 'r' || r_regionkey AS edge, CAST(NULL AS VARCHAR) AS parent, CAST(coalesce((SELECT sum(flow) FROM n WHERE n.parent = 'r' || r_regionkey), 0) AS DECIMAL(12,2)) AS flow, {LENGTH.format('r_regionkey')} AS length FROM region),
{_level('dc', 'c', None)}, {_level('dn_', 'n', 'dc')}, {_level('dr', 'r', 'dn_')},
found AS (SELECT * FROM dc UNION ALL SELECT * FROM dn_ UNION ALL SELECT * FROM dr), every AS (SELECT * FROM c UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r)
SELECT e.edge, e.flow, f.dn, f.tail FROM every e LEFT JOIN found f ON f.edge = e.edge""")
def path_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters of the forest of regions, nations and customers, sized along paths from the leaves up."""
    f = _forest(spark, sf_dir)
    key = F.regexp_extract("node", r"\d+", 0).cast("long")
    return tree.path_diameters(f.select(F.col("node").alias("edge"), "parent", length_of(key).alias("length"), F.col("flow").alias("demand")))


@register("component_uplift", f"""WITH {FLOWS}, e AS (SELECT custkey, nationkey, {DN_OF.format('flow')} AS dn, {LENGTH.format('custkey')} AS length FROM flows WHERE connected),
g AS (SELECT nationkey, dn, sum(length) AS total FROM e GROUP BY nationkey, dn)
SELECT e.custkey, e.dn, CASE WHEN g.total > c.max_length + CAST(0.000001 AS DECIMAL(18,9)) THEN (SELECT min(dn) FROM {C} WHERE dn > e.dn) ELSE e.dn END AS lifted FROM e JOIN g ON g.nationkey = e.nationkey AND g.dn = e.dn JOIN (SELECT * FROM {C}) c ON c.dn = e.dn""")
def component_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of lifting the components of one dn: pipes that leave one nation with one dn are one."""
    e = flows(spark, sf_dir).where("connected").select(
        F.col("custkey").alias("edge"), F.concat(F.lit("n"), "nationkey").alias("a"), F.concat(F.lit("c"), "custkey").alias("b"),
        catalog.base_dn(F.col("flow")).alias("dn"), length_of(F.col("custkey")).alias("length"),
    )
    return sizing.uplift(e, rounds=1).select(F.col("edge").alias("custkey"), "dn", "lifted")


@register("path_maximum", f"""WITH RECURSIVE {DEEP}, down AS (SELECT node, parent, size AS dn FROM deep WHERE parent IS NULL UNION ALL SELECT d.node, d.parent, greatest(u.dn, d.size) FROM down u JOIN deep d ON d.parent = u.node) SELECT node, dn FROM down""")
def path_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size on the way from the root."""
    return tree.climb(deep(spark, sf_dir), along={"size": "max"}).select("node", F.col("size").alias("dn"))


@register("tie_in_walk", f"""WITH RECURSIVE {DEEP}, down AS (SELECT node, CASE WHEN node BETWEEN 1 AND 3 THEN node END AS root, {LENGTH.format('node')} AS length FROM deep WHERE node BETWEEN 1 AND 3 UNION ALL SELECT d.node, u.root, CAST(u.length + {LENGTH.format('d.node')} AS DECIMAL(18,9)) FROM down u JOIN deep d ON d.parent = u.node),
s AS (SELECT root, count(*) AS served FROM down GROUP BY root), l AS (SELECT root, row_number() OVER (ORDER BY served DESC, root) AS label FROM s)
SELECT d.node, d.root, d.length, CAST(l.label AS INTEGER) AS label FROM down d JOIN l ON l.root = d.root""")
def tie_in_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of each node to its tie-in, and labels of the tie-ins by how many they serve."""
    d = deep(spark, sf_dir).where("node > 0").withColumn("parent", F.when(F.col("node") > 3, F.col("parent")))
    way = tree.climb(d.withColumn("length", length_of(F.col("node"))), along={"length": "sum"})
    labels = way.groupBy("root").agg(F.count("*").alias("served"))
    labels = labels.select("root", F.row_number().over(Window.orderBy(F.desc("served"), "root")).alias("label"))
    return way.join(labels, "root").select("node", "root", "length", "label")


@register("reconstruction_loads", f"""WITH RECURSIVE {DEEP}, e AS (SELECT node AS edge, parent, 5 + (node * 37) % 200 AS length, CAST(size AS DECIMAL(12,2)) AS flow FROM deep),
ties AS (SELECT l_partkey AS edge, l_orderkey % (6 + (l_partkey * 37) % 200) AS station, sum(CAST(l_quantity AS DECIMAL(12,2))) AS flow FROM lineitem GROUP BY 1, 2),
ways AS (SELECT edge, station AS b, flow FROM ties UNION ALL SELECT up.edge, up.length, w.flow FROM ways w JOIN e AS down ON down.edge = w.edge JOIN e AS up ON up.edge = down.parent),
zones AS (SELECT edge, b, sum(flow) AS flow FROM ways WHERE b > 0 GROUP BY edge, b),
ends AS (SELECT edge, 0 AS a FROM zones UNION SELECT edge, b FROM zones), parts AS (SELECT * FROM (SELECT edge, a, lead(a) OVER (PARTITION BY edge ORDER BY a) AS b FROM ends) WHERE b IS NOT NULL),
loads AS (SELECT p.edge, p.a, p.b, CAST(sum(z.flow) AS DECIMAL(18,2)) AS added FROM parts p JOIN zones z ON z.edge = p.edge AND z.b >= p.b GROUP BY p.edge, p.a, p.b),
sized AS (SELECT l.*, (SELECT min(dn) FROM {C} WHERE capacity >= e.flow) AS old_dn, (SELECT min(dn) FROM {C} WHERE capacity >= e.flow + l.added) AS new_dn FROM loads l JOIN e ON e.edge = l.edge)
SELECT edge, a, b, added, new_dn FROM sized WHERE new_dn IS NULL OR new_dn > old_dn""")
def reconstruction_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of the deep tree, an edge above each part, that the line items tied in on it make too narrow."""
    e = deep(spark, sf_dir).select(F.col("node").alias("edge"), "parent", (5 + (F.col("node") * 37) % 200).alias("length"), F.col("size").cast("decimal(12,2)").alias("flow"))
    station = F.col("l_orderkey") % (6 + (F.col("l_partkey") * 37) % 200)
    ties = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("edge"), station.alias("station"), F.col("l_quantity").cast("decimal(12,2)").alias("flow"))
    return sizing.reconstruction(e.withColumn("dn", catalog.base_dn(F.col("flow"))), ties)
