"""Queries of prices of choices, of pools and ranks of candidates, and of the search for layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from calorgrid.functions import catalog
from calorgrid.operators import lines as shapes, network, search
from calorgrid.plans.layout import C, DN_OF, kinds
from calorgrid.plans.plane import boxes
from calorgrid.plans.tables import FLOWS, flows, table
from calorgrid.queries import register

OPTIONS = "options AS (SELECT o_orderkey AS option, o_custkey % 40 AS block, o_custkey % 5 AS grouping, CAST(o_totalprice * 100 AS BIGINT) AS cost FROM orders)"


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """option, block, grouping and cost: a candidate per order."""
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("option"), (k % 40).alias("block"), (k % 5).alias("grouping"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))


OPTIONS = OPTIONS.replace("CAST(o_totalprice * 100 AS BIGINT)", "CAST(round(o_totalprice * 100) AS BIGINT)")


@register("finalists", f"WITH {OPTIONS} SELECT block, option, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY cost, option) AS rank FROM options) WHERE rank <= 8")
def finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight cheapest candidates of each block, for the exact evaluation."""
    return network.best_of(options(spark, sf_dir), ["block"], ["cost", "option"], 8).select("block", "option", "rank")


@register("block_elite", f"WITH {OPTIONS}, g AS (SELECT *, row_number() OVER (PARTITION BY block, grouping ORDER BY cost, option) AS nth FROM options) SELECT block, grouping, option, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY cost, option) AS rank FROM g WHERE nth = 1) WHERE rank <= 3")
def block_elite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each of the three best groupings of a block."""
    one = network.best_of(options(spark, sf_dir), ["block", "grouping"], ["cost", "option"], 1).drop("rank")
    return network.best_of(one, ["block"], ["cost", "option"], 3).select("block", "grouping", "option", "rank")


SERVED = "served AS (SELECT l_orderkey AS option, count(DISTINCT l_partkey % 30) AS demands FROM lineitem GROUP BY l_orderkey)"


@register("marginal_gain", f"WITH {OPTIONS}, {SERVED} SELECT option, demands, gain, CAST(rank AS INTEGER) AS rank FROM (SELECT o.block, o.option, s.demands, round((10000000 * s.demands - o.cost)::DOUBLE / s.demands::DOUBLE, 6) AS gain, row_number() OVER (PARTITION BY o.block ORDER BY round((10000000 * s.demands - o.cost)::DOUBLE / s.demands::DOUBLE, 6) DESC, o.option) AS rank FROM options o JOIN served s ON s.option = o.option) WHERE rank <= 5")
def marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five candidates of each block that gain most per demand they serve."""
    served = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("option")).agg(F.count_distinct(F.col("l_partkey") % 30).alias("demands"))
    gain = F.round((F.lit(10000000) * F.col("demands") - F.col("cost")).cast("double") / F.col("demands").cast("double"), 6)
    rows = options(spark, sf_dir).join(served, "option").withColumn("gain", gain)
    return network.best_of(rows, ["block"], [F.desc("gain"), "option"], 5).select("option", "demands", "gain", "rank")


@register("invalid_probe", "SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900) AS broken FROM nation")
def invalid_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a map has an invalid object at all: a semi join, which stops at the first."""
    broken = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    hit = n.join(broken, "n_nationkey", "left_semi").withColumn("broken", F.lit(True))
    return n.join(hit, "n_nationkey", "left").select("n_nationkey", F.coalesce("broken", F.lit(False)).alias("broken"))


@register("variant_pool", f"WITH {OPTIONS}, pool AS (SELECT option // 3 AS signature, 'a' AS engine, cost FROM options WHERE option % 3 < 2 UNION ALL SELECT option // 3, 'b', cost + option % 7 FROM options WHERE option % 3 > 0) SELECT signature, min(cost) AS cost, count(*) AS found, arg_min(engine, cost * 2 + CASE engine WHEN 'a' THEN 0 ELSE 1 END) AS engine FROM pool GROUP BY signature")
def variant_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of two engines in one pool: of those with one signature the cheapest, the first engine's on a tie."""
    o = options(spark, sf_dir)
    key = F.floor(F.col("option") / 3).alias("signature")
    a = o.where("option % 3 < 2").select(key, F.lit("a").alias("engine"), "cost")
    b = o.where("option % 3 > 0").select(key, F.lit("b").alias("engine"), (F.col("cost") + F.col("option") % 7).alias("cost"))
    best = F.min(F.struct("cost", "engine"))
    return a.unionByName(b).groupBy("signature").agg(best.alias("m"), F.count("*").alias("found")).select("signature", "m.cost", "found", "m.engine")


@register("interval_overlap", "WITH z AS (SELECT event_id, user_id AS line, event_id % 1000 AS a, event_id % 1000 + 3 + event_id % 40 AS b FROM events) SELECT line, event_id, greatest(a, 200) AS a, least(b, 700) AS b, a < 200 OR b > 700 AS cut FROM z WHERE a < 700 AND b > 200")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each stretch lies in a window of stations."""
    e = F.col("event_id")
    z = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("line"), (e % 1000).alias("a"), (e % 1000 + 3 + e % 40).alias("b")).where("a < 700 and b > 200")
    return z.select("line", "event_id", F.greatest("a", F.lit(200)).alias("a"), F.least("b", F.lit(700)).alias("b"), ((F.col("a") < 200) | (F.col("b") > 700)).alias("cut"))


@register("special_objects", "SELECT p_partkey, ['road', 'tram_tracks', 'gas_pipeline', 'power_cable', 'heat_network', 'park'][CAST(p_partkey % 6 AS INTEGER) + 1] <> 'park' AS special FROM part")
def special_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects may be crossed at a price."""
    return table(spark, sf_dir, "part").select("p_partkey", kinds(F.col("p_partkey")).isin(*catalog.FACTOR).alias("special"))


@register("tie_in_cost", f"WITH {FLOWS} SELECT nationkey, count(*) AS rays, count(*) * 5000000 AS cost FROM flows WHERE connected GROUP BY nationkey")
def tie_in_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tying pipes into existing chambers costs."""
    return flows(spark, sf_dir).where("connected").groupBy("nationkey").agg(F.count("*").alias("rays"), (F.count("*") * catalog.TIE_IN_PRICE).alias("cost"))


@register("metre_weight", f"WITH {FLOWS}, d AS (SELECT custkey, {DN_OF.format('flow')} AS dn FROM flows) SELECT d.custkey, d.dn, CAST(c.new_price * CAST(0.000000028 AS DECIMAL(10,9)) + CAST(0.003 AS DECIMAL(4,3)) AS DECIMAL(20,12)) AS weight, c.rebuild_price AS rebuild FROM d JOIN (SELECT * FROM {C}) c ON c.dn = d.dn")
def metre_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a metre of pipe adds to the objective, and what rebuilding a metre costs."""
    d = flows(spark, sf_dir).select("custkey", catalog.base_dn(F.col("flow")).alias("dn")).where("dn is not null")
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)")
    weight = price * F.lit("0.000000028").cast("decimal(10,9)") + F.lit("0.003").cast("decimal(4,3)")
    return d.select("custkey", "dn", weight.cast("decimal(20,12)").alias("weight"), catalog.of_pipe(F.col("dn"), "rebuild_price", "decimal(12,2)").alias("rebuild"))


@register("seed_streams", "SELECT n_nationkey, r.r AS restart, CAST(CAST(concat('0x', substr(md5(concat('7:', n_nationkey, ':', r.r)), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS draw FROM nation CROSS JOIN (SELECT unnest(range(8)) AS r) r")
def seed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number per scene and restart that depends on nothing else."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("restart"))
    return n.withColumn("draw", search.stream(7, F.col("n_nationkey"), F.col("restart")))


@register("simplify_collinear")
def simplify_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without repeated points and without points that lie straight between those kept."""
    e = F.col("event_id")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), e.alias("seq"), (F.floor(e / 40) % 6).cast("double").alias("x"), (F.floor(e / 80) % 3).cast("double").alias("y"))
    return shapes.simplify(v)


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A map per nation: its customers, its suppliers as roots, and boxes as objects of six kinds."""
    k = F.col("custkey")
    f = flows(spark, sf_dir)
    demands = f.select(F.col("nationkey").alias("scene_id"), k.alias("demand"), ((k * 7919) % 5000 + k % 23 - 11).cast("double").alias("x"), ((k * 104729) % 5000 + k % 19 - 9).cast("double").alias("y"), "flow")
    s = F.col("s_suppkey")
    roots = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scene_id"), s.alias("root"), ((s * 7919) % 5000).cast("double").alias("rx"), ((s * 104729) % 5000).cast("double").alias("ry"), (1 + s % 3).alias("free"))
    b = boxes(spark, sf_dir).withColumn("kind", kinds(F.col("box"))).withColumn("scene_id", (F.col("box") % 25).cast("int"))
    side = "array(struct(x1, y1, x2, y1 AS y2), struct(x2 AS x1, y1, x2, y2), struct(x2 AS x1, y2 AS y1, x1 AS x2, y2), struct(x1, y2 AS y1, x1 AS x2, y1 AS y2))"
    walls = b.select("scene_id", F.col("box").alias("wall"), "kind", F.explode(F.expr(side)).alias("s")).select("scene_id", "wall", "kind", *[F.col(f"s.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return demands, roots, walls


@register("candidate_routes")
def candidate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways from each consumer to its nearest roots that the rules allow."""
    return search.routes(*_scene(spark, sf_dir))


@register("solve_scene")
def solve_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three ranked layouts of each map, the best of four restarts."""
    demands, roots, walls = _scene(spark, sf_dir)
    return search.variants(search.routes(demands, roots, walls), demands)[1]


@register("greedy_cover")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that cover the demands of a scene, cheapest per demand first."""
    return search.greedy_cover(_sets(spark, sf_dir))


@register("exact_cover")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest options that serve each of a scene's eight demands once."""
    sets = _sets(spark, sf_dir)
    return search.exact_cover(sets, sets.select("scene_id", F.explode("demands").alias("demand")).distinct())


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    demand = F.array_sort(F.collect_set(F.col("l_partkey") % 8))
    return rows.groupBy((F.col("o_custkey") % 20).alias("scene_id"), F.col("o_orderkey").alias("option")).agg(F.floor(F.max("o_totalprice")).cast("double").alias("cost"), demand.alias("demands"))


@register("distance_field")
def distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way from a scene's roots to every cell of a small grid of prices."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene_id"))
    line = lambda name: F.explode(F.sequence(F.lit(0), F.lit(11))).alias(name)
    cells = n.select("scene_id", line("x")).select("*", line("y")).withColumn("price", 1 + (F.col("x") * 7 + F.col("y") * 3 + F.col("scene_id")) % 5)
    seeds = n.select("scene_id", (F.col("scene_id") % 12).alias("x"), (F.col("scene_id") * 5 % 12).alias("y"))
    return search.fields(cells.where("(x + y) % 9 <> 4"), seeds)
