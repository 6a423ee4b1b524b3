"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calorgrid.llm import hot, store

MAX_ROUNDS = 60


def _with_min(edges: DataFrame, n: int, tables: store.Scratch) -> DataFrame:
    """u, v and m, the least v of each u. The centre of a giant star is spread."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    if n <= hot.HOT:
        return edges.join(low, "u").drop("_n")
    return hot.spread_join(edges, tables.cut(low, "least"), ["u"], "_n", "v").drop("_n")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node that links reach) of each node with a link to another node.

    Each round rewires every node's neighbours to its least one and writes the edges to the shared folder, where
    the last round's are deleted; it ends when a round changes nothing, and with an error if MAX_ROUNDS, far more
    than the logarithm of any number of nodes, do not do. Nodes are long integers; nulls and links of a node to
    itself count as none. Large groups are never gathered: a step is a grouped minimum and a join.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    with store.Scratch(spark, "components") as tables:
        edges = tables.cut(pairs, "edges")
        n = edges.count()
        before = None
        for _ in range(MAX_ROUNDS):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = _with_min(both, 2 * n, tables).withColumn("m", F.least("u", "m"))
            large = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # all edges now point to lower nodes
            low = _with_min(large, n, tables)
            small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
            last, edges = edges, tables.cut(small, "edges")
            tables.drop(last)
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            n = now["n"]
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return store.cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
