"""Undirected graphs: connected components by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from calorgrid.operators.lineage import cut

MAX_ROUNDS = 100
HOT = 1 << 16  # edges of a node from which they are dealt over SALTS tasks
SALTS = 64


def _least(edges: DataFrame, many: bool) -> DataFrame:
    """u, v and m, the least neighbour v of each u. With `many` edges the star of a giant component is spread: the
    list of its centres, at most twice as many as edges / HOT, is broadcast."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    if not many:
        return edges.join(low.drop("_n"), "u")
    hot = F.broadcast(low.where(F.col("_n") > HOT).orderBy(F.desc("_n")).limit(4096).select("u", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = edges.join(hot, "u", "left").withColumn("_salt", salt).drop("_hot")
    right = low.join(hot, "u", "left").withColumn("_salt", F.explode(every)).drop("_hot", "_n")
    return left.join(right, ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of each node; edges have a and b.

    Rounds of large and small stars: each hangs the neighbours of a node on the least of them, until nothing
    changes. The labels of giant components never meet in one task, and a round keeps at most as many edges.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars, before = cut(pairs), None
    for _ in range(MAX_ROUNDS):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            own = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        before, many = now, now[0] > HOT
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, many).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = _least(large, many)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        stars = cut(small.distinct(), stars)
    raise RuntimeError("labels did not settle")
