"""Verification of stand-in results with planted faults (a map per nation, a star of pipes around its chamber), the
gate before publication, and diagnostics of consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.functions import catalog, pricing
from calorgrid.operators import publish, spatial, verify
from calorgrid.plans.layout import C, DN_OF
from calorgrid.plans.plane import BOXES, CELL, POINTS, boxes, points
from calorgrid.plans.tables import FLOWS, flows, table
from calorgrid.queries import register
from calorgrid.sources import geojson

X, Y = "custkey % 60 * 17 - 500", "100 + custkey"


def _point(x, y):
    return F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))


def stand_in(spark: SparkSession, sf_dir: str) -> tuple[geojson.Scenes, verify.Result]:
    """A chamber between two pipes per nation, its customers as consumers, and a pipe to each connected one. Some
    pipes are a size too wide (keys divisible by 7), carry another flow (11) or cost (13) than they should, some
    consumers without a pipe are not named (5), and summaries name no totals."""
    f = flows(spark, sf_dir).withColumn("scene_id", F.concat(F.lit("n"), "nationkey"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("scene_id"))
    none = F.lit(None)
    given = n.select("scene_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(t).alias("object_type"), F.array(*[_point(str(x), "0") for x in xs]).alias("line"))
        for i, t, xs in (("chamber", "heat_chamber", (0,)), ("west", "heat_network", (-90, 0)), ("east", "heat_network", (0, 90)))
    ])).alias("o")).select("scene_id", "o.*")
    ends = f.select("scene_id", F.concat(F.lit("c"), "custkey").alias("id"), F.lit("oks_connection_point").alias("object_type"), F.array(_point(X, Y)).alias("line"), "flow")
    both = given.withColumn("flow", none.cast("decimal(12,2)")).union(ends)
    dn = F.when(F.col("object_type") != "oks_connection_point", F.lit(400))
    objects = both.select("scene_id", "id", F.col("id").alias("id_text"), F.lit("STRING").alias("id_type"), "object_type", none.cast("string").alias("kind"), dn.alias("dn"), F.col("flow").cast("decimal(18,6)").alias("flow"), F.lit(True).alias("valid"))
    parts = both.select("scene_id", "id", F.lit(0).alias("part"), F.when(F.size("line") > 1, 1).otherwise(0).alias("dim"), F.array("line").alias("rings"))
    notes = both.where("false").select("scene_id", "id", F.lit("").alias("severity"), F.lit("").alias("code"), F.lit("").alias("said"))

    k = F.col("custkey")
    base = catalog.base_dn(F.col("flow"))
    wide = F.when(k % 7 == 0, catalog.next_dn(base)).otherwise(base)
    length = F.round(F.hypot(F.expr(X).cast("double"), F.expr(Y).cast("double")), 9).cast("decimal(18,9)")
    cost = pricing.money(F.col("length") * catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)")).cast("decimal(24,2)")
    lines = f.where("connected").withColumns({"dn": wide, "length": length})
    lines = lines.select(
        "scene_id", F.lit("v").alias("variant_id"), F.concat(F.lit("l"), k).alias("id"), F.lit("chamber").alias("start"), F.lit("STRING").alias("start_type"),
        F.concat(F.lit("c"), k).alias("end"), F.lit("STRING").alias("end_type"), "dn", (F.col("flow") + (k % 11 == 0).cast("int")).cast("decimal(18,6)").alias("flow"),
        "length", (cost + (k % 13 == 0).cast("int")).cast("decimal(24,2)").alias("cost"), F.lit("base").alias("method"),
        none.cast("double").alias("depth_start"), none.cast("double").alias("depth_end"), F.array(_point("0", "0"), _point(X, Y)).alias("points"),
    )
    nodes = n.where("false").select("scene_id", F.lit("v").alias("variant_id"), F.lit("").alias("id"), F.lit("STRING").alias("id_type"), F.lit("").alias("object_type"), F.lit(0).alias("dn"), F.lit(0).cast("decimal(24,2)").alias("cost"), _point("0", "0").alias("p"))
    missing = f.where("not connected and custkey % 5 <> 0").groupBy("scene_id").agg(F.collect_list(F.struct(F.concat(F.lit("c"), k).alias("id"), F.lit("STRING").alias("kind"))).alias("unconnected"))
    empty = F.array().cast("array<struct<id:string,kind:string>>")
    money = [none.cast("decimal(24,2)").alias(c) for c in ("construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost")]
    summaries = n.join(missing, "scene_id", "left").select("scene_id", F.lit("v").alias("variant_id"), F.lit("sum").alias("id"), F.lit(1).alias("rank"), *money, none.cast("decimal(28,12)").alias("score"), none.cast("decimal(28,9)").alias("new_network_length"), none.cast("long").alias("existing_chamber_tie_in_count"), F.coalesce("unconnected", empty).alias("unconnected"))
    return geojson.Scenes(objects, parts, notes), verify.Result(lines, nodes, summaries)


@register("verify_all", f"""WITH {FLOWS}, l AS (SELECT *, 'n' || nationkey AS scene_id, {DN_OF.format('flow')} AS base, CAST(round(sqrt(CAST(({X}) * ({X}) + ({Y}) * ({Y}) AS DOUBLE)), 9) AS DECIMAL(18,9)) AS length FROM flows WHERE connected),
d AS (SELECT l.*, CASE WHEN custkey % 7 = 0 THEN (SELECT min(dn) FROM {C} WHERE dn > l.base) ELSE l.base END AS dn, (SELECT min(dn) FROM {C} WHERE capacity >= l.flow AND max_length >= l.length) AS least FROM l),
found AS (SELECT scene_id, 'DIAMETER' AS code, count(*) AS n FROM d WHERE least IS NOT NULL AND dn <> least GROUP BY scene_id UNION ALL SELECT scene_id, 'LENGTH_LIMIT', count(*) FROM d WHERE least IS NULL GROUP BY scene_id
UNION ALL SELECT scene_id, 'NODE_DEGREE', 1 FROM d GROUP BY scene_id HAVING count(*) > 2 UNION ALL SELECT 'n' || nationkey, 'UNCONNECTED_IDS', count(*) FROM flows WHERE NOT connected AND custkey % 5 = 0 GROUP BY nationkey
UNION ALL SELECT 'n' || n_nationkey, 'VALUE_MISMATCH', 8 + (SELECT count(*) FROM d WHERE scene_id = 'n' || n_nationkey AND custkey % 11 = 0) + (SELECT count(*) FROM d WHERE scene_id = 'n' || n_nationkey AND custkey % 13 = 0) FROM nation)
SELECT scene_id, code, CAST(n AS BIGINT) AS n FROM found""")
def verify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule is broken in each map of the stand-in."""
    return verify.verify(*stand_in(spark, sf_dir)).groupBy("scene_id", "code").agg(F.count("*").alias("n"))


@register("publish_gate", f"""WITH {FLOWS}, v AS (SELECT o_custkey % 25 AS scene_id, o_orderkey AS variant_id, CAST(o_orderkey % 4 AS BIGINT) AS missing, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS cost FROM orders WHERE o_custkey % 25 <> 3),
s AS (SELECT v.*, CAST(cost * CAST(0.000000028 AS DECIMAL(10,9)) AS DECIMAL(28,12)) AS score FROM v WHERE variant_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 9 = 0)),
k AS (SELECT * FROM (SELECT *, min(missing) OVER (PARTITION BY scene_id) AS least FROM s) WHERE missing = least),
d AS (SELECT nationkey AS scene_id, count(*) AS missing, CAST(sum(CAST(100000000 + flow * 500000 AS DECIMAL(20,2))) AS DECIMAL(18,2)) AS cost FROM flows WHERE nationkey NOT IN (SELECT scene_id FROM k) GROUP BY nationkey)
SELECT scene_id, CAST(variant_id AS VARCHAR) AS variant_id, missing, cost, score, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY score, variant_id) AS INTEGER) AS rank, FALSE AS fallback FROM k
UNION ALL SELECT scene_id, 'none', missing, cost, CAST(cost * CAST(0.000000028 AS DECIMAL(10,9)) AS DECIMAL(28,12)), 1, TRUE FROM d""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of each scene that may be published, and the fallback where none may."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 25 <> 3")
    cost = F.round("o_totalprice", 2).cast("decimal(18,2)")
    v = o.select((F.col("o_custkey") % 25).alias("scene_id"), F.col("o_orderkey").alias("variant_id"), (F.col("o_orderkey") % 4).alias("missing"), cost.alias("cost"), pricing.score(cost, F.lit(0)).alias("score"))
    bad = table(spark, sf_dir, "lineitem").where("l_partkey % 9 = 0").select(F.col("l_orderkey").alias("variant_id")).distinct()
    demands = flows(spark, sf_dir).select(F.col("nationkey").cast("long").alias("scene_id"), F.col("custkey").alias("demand"), "flow")
    return publish.gate(v, v.join(bad, "variant_id").select("scene_id", "variant_id"), demands)


@register("terminal_diagnostics", f"""WITH {FLOWS}, {POINTS}, {BOXES}, p AS (SELECT p.* FROM points p JOIN flows f ON f.custkey = p.point WHERE NOT f.connected),
d AS (SELECT p.point, b.box, greatest(b.x1 - p.x, p.x - b.x2, 0) * greatest(b.x1 - p.x, p.x - b.x2, 0) + greatest(b.y1 - p.y, p.y - b.y2, 0) * greatest(b.y1 - p.y, p.y - b.y2, 0) AS d2 FROM p JOIN boxes b ON greatest(b.x1 - p.x, p.x - b.x2, 0) <= 60 AND greatest(b.y1 - p.y, p.y - b.y2, 0) <= 60)
SELECT p.point, count(d.box) AS near, coalesce(sum(CASE WHEN d.d2 = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS inside, min(d.d2) AS d2, arg_min(d.box, d.d2 * 10000000 + d.box) AS box FROM p LEFT JOIN d ON d.point = p.point AND d.d2 <= 3600 GROUP BY p.point""")
def terminal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a consumer may have stayed unconnected: the objects within 60 m of it, those that it lies in, the nearest."""
    lost = flows(spark, sf_dir).where("not connected").select(F.col("custkey").alias("point"))
    p = points(spark, sf_dir).join(lost, "point")
    at = tuple(F.col(c) + m for c, m in (("x", -60), ("y", -60), ("x", 60), ("y", 60)))
    pairs = spatial.near(p, boxes(spark, sf_dir), at, tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), CELL)
    dx, dy = (F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2"), F.lit(0)) for c in ("x", "y"))
    near = pairs.withColumn("d2", dx * dx + dy * dy).where("d2 <= 3600").groupBy("point")
    order = F.col("d2").cast("decimal(20,0)") * F.lit("1e19").cast("decimal(20,0)") + F.col("box")  # a number, as a least pair takes a sort
    near = near.agg(F.count("*").alias("near"), F.count_if(F.col("d2") == 0).alias("inside"), F.min("d2").alias("d2"), F.min_by("box", order).alias("box"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.select("point").join(near, "point", "left").select("point", zero("near"), zero("inside"), "d2", "box")
