"""The stand-ins that queries share, each with the SQL of the same rows.

flows: a consumer per customer, its flow the sum of its orders' quantities; customers with a negative balance
count as unconnected. edges: a forest of regions, nations and customers, with lengths from their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def length_of(key: Column) -> Column:
    return (5 + (key * 37) % 200).cast("decimal(18,9)")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, nationkey, flow, connected."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("q").alias("q"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return who.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), F.coalesce("q", F.lit(0.0)).cast("decimal(12,2)").alias("flow"), (F.col("c_acctbal") >= 0).alias("connected"))


FLOWS = """flows AS (
  SELECT c.c_custkey AS custkey, c.c_nationkey AS nationkey, CAST(coalesce(q.q, 0) AS DECIMAL(12,2)) AS flow, c.c_acctbal >= 0 AS connected
  FROM customer c LEFT JOIN (SELECT o.o_custkey, sum(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey) q ON q.o_custkey = c.c_custkey)"""


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, size of a deep tree of parts; the part of key 0 is the root."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 3).cast("long")).alias("parent"), F.col("p_size").cast("long").alias("size"))


DEEP = "deep AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, CAST(p_size AS BIGINT) AS size FROM part)"
