"""Identifiers, names, warnings, sets and summaries of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from calorgrid.functions import catalog
from calorgrid.plans.tables import FLOWS, flows, table
from calorgrid.queries import register

NAMES = "[' School', 'ROAD', 'oks', 'kindergarten ', 'Gas_Pipeline', 'fence', '', 'metro'][CAST(p_partkey % 8 AS INTEGER) + 1]"


@register("vocabulary", f"WITH n AS (SELECT p_partkey, lower(trim({NAMES})) AS name FROM part) SELECT p_partkey, CASE WHEN name IN ('oks', 'building', 'oks_existing') THEN 'building' WHEN name IN ('social_area', 'school', 'kindergarten') THEN 'social_area' WHEN name IN ('water', 'park', 'prohibited_site', 'road', 'tram_tracks', 'gas_pipeline', 'power_cable', 'railway', 'metro', 'heat_network') THEN name END AS kind FROM n")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in (" School", "ROAD", "oks", "kindergarten ", "Gas_Pipeline", "fence", "", "metro")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.kind_of(names).alias("kind"))


def plain_id(text):
    """An id without trailing zeros after its point."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


IDS = "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) || '.0' WHEN c_custkey % 3 = 1 THEN CAST(c_custkey // 2 AS VARCHAR) ELSE 'x' || CAST(c_custkey AS VARCHAR) END"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    half = F.floor(k / 2).cast("string")
    said = F.when(k % 3 == 0, F.concat(half, F.lit(".0"))).when(k % 3 == 1, half).otherwise(F.concat(F.lit("x"), k))
    return table(spark, sf_dir, "customer").select(k.alias("row"), plain_id(said).alias("id"))


NORMAL = f"ids AS (SELECT c_custkey AS \"row\", regexp_replace(regexp_replace({IDS}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS id FROM customer)"


RESULT_IDS = "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey * 2 AS VARCHAR) || '.00' WHEN s_suppkey % 3 = 1 THEN 'x' || CAST(s_suppkey AS VARCHAR) ELSE 'lct_' || CAST(s_suppkey // 6 AS VARCHAR) END"


@register("id_collision", f"""WITH {NORMAL}, r AS (SELECT s_suppkey, regexp_replace(regexp_replace({RESULT_IDS}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS id FROM supplier)
SELECT s_suppkey, id, CASE WHEN id IN (SELECT id FROM ids) THEN 'input' ELSE 'result' END AS met FROM r WHERE id IN (SELECT id FROM ids) OR id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1)""")
def id_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a result that an input object has, or another object of the result."""
    k = F.col("s_suppkey")
    said = F.when(k % 3 == 0, F.concat((k * 2).cast("string"), F.lit(".00"))).when(k % 3 == 1, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("lct_"), F.floor(k / 6)))
    result = table(spark, sf_dir, "supplier").select("s_suppkey", plain_id(said).alias("id"))
    taken = _ids(spark, sf_dir).select("id").distinct().withColumn("_taken", F.lit(True))
    twice = result.groupBy("id").agg((F.count("*") > 1).alias("_twice"))
    met = result.join(taken, "id", "left").join(twice, "id").where("_taken or _twice")
    return met.select("s_suppkey", "id", F.when(F.col("_taken"), "input").otherwise("result").alias("met"))


@register("duplicate_alias", f"WITH {NORMAL} SELECT \"row\", id || CASE WHEN row_number() OVER (PARTITION BY id ORDER BY \"row\") > 1 THEN '~dup' ELSE '' END AS id FROM ids")
def duplicate_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    return _ids(spark, sf_dir).select("row", F.concat("id", F.when(nth > 1, "~dup").otherwise("")).alias("id"))


@register("warning_caps", """WITH c AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS total FROM events), k AS (SELECT * FROM c WHERE nth <= 20), g AS (SELECT *, row_number() OVER (ORDER BY event_id) AS place FROM k)
SELECT event_id, event_type, CAST(nth AS INTEGER) AS nth, total FROM g WHERE place <= 500""")
def warning_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 warnings of each code and 500 in all, with the count of each code. The rank within a code
    is limited before anything is sorted, and the counts are a grouped aggregate, so no code is gathered."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    first = e.withColumn("nth", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("nth <= 20")
    return first.orderBy("event_id").limit(500).join(e.groupBy("event_type").agg(F.count("*").alias("total")), "event_type").select("event_id", "event_type", "nth", "total")


@register("audit", f"WITH {FLOWS} SELECT count(*) AS demands, CAST(sum(flow) AS DECIMAL(20,2)) AS total_flow, CAST(sum(CASE WHEN connected THEN 0 ELSE 1 END) AS BIGINT) AS invalid, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS networks, (SELECT CAST(sum(5 + (s_suppkey * 37) % 200) AS BIGINT) FROM supplier) AS network_length FROM flows")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = flows(spark, sf_dir).agg(F.count("*").alias("demands"), F.sum("flow").cast("decimal(20,2)").alias("total_flow"), F.count_if(~F.col("connected")).alias("invalid"))
    b = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    c = table(spark, sf_dir, "supplier").agg(F.count("*").alias("networks"), F.sum(5 + (F.col("s_suppkey") * 37) % 200).alias("network_length"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@register("distinct_variants", "WITH v AS (SELECT l_orderkey AS variant, l_partkey % 3 AS a, l_suppkey % 3 AS b FROM lineitem), s AS (SELECT variant, sha256(string_agg(DISTINCT CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR))) AS signature FROM v GROUP BY variant) SELECT signature, min(variant) AS variant, count(*) AS n FROM s GROUP BY signature")
def distinct_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the same set of edges are one: a hash of the sorted set."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("variant"), F.concat_ws("-", F.col("l_partkey") % 3, F.col("l_suppkey") % 3).alias("edge"))
    s = v.groupBy("variant").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("edge")), ","), 256).alias("signature"))
    return s.groupBy("signature").agg(F.min("variant").alias("variant"), F.count("*").alias("n"))


@register("unconnected_diff", "WITH expected AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), reported AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 100 AND c_custkey % 7 <> 0) SELECT coalesce(e.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'missing' ELSE 'unexpected' END AS what FROM expected e FULL JOIN reported r ON e.id = r.id WHERE e.id IS NULL OR r.id IS NULL")
def unconnected_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    expected, reported = c.where("c_acctbal < 0").select("id", F.lit(True).alias("e")), c.where("c_acctbal < 100 and id % 7 <> 0").select("id", F.lit(True).alias("r"))
    return expected.join(reported, "id", "full").where("e is null or r is null").select("id", F.when(F.col("r").isNull(), "missing").otherwise("unexpected").alias("what"))


@register("disjoint_groups", "WITH m AS (SELECT DISTINCT s_suppkey AS g, (s_suppkey * k) % 400 AS d FROM supplier, (VALUES (3), (7), (11)) t(k)) SELECT x.g AS a, y.g AS b, count(*) AS shared FROM m x JOIN m y ON x.d = y.d AND x.g < y.g GROUP BY x.g, y.g")
def disjoint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of groups that are not disjoint, and how many demands they share."""
    g = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").select(g.alias("a"), F.array_sort(F.array_distinct(F.array(*[(g * k) % 400 for k in (3, 7, 11)]))).alias("d"))
    # a pair is kept at the least demand that it shares, so nothing is grouped; the join is told to shuffle, as few rows make many pairs
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = m.distinct().withColumn("k", F.explode("d")).repartition(n, "k")
    right = left.select(F.col("a").alias("b"), F.col("d").alias("e"), "k").hint("merge")
    both = F.array_intersect("d", "e")
    return left.join(right, "k").where("a < b").withColumn("both", both).where(F.array_min("both") == F.col("k")).select("a", "b", F.size("both").cast("long").alias("shared"))
