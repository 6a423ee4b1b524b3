"""Undirected trees given as edges: which way each edge leads, in a logarithm of rounds.

Each edge is walked twice, as two arcs. At a node the arc in on one edge is followed by the arc out on the next edge
of the node, so the arcs of a tree form one round trip, which is cut open at the root. Pointer doubling counts for
each arc the steps that are left; of an edge's two arcs the one with more of them leads away from the root.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.operators.lineage import cut


def ranks(links: DataFrame) -> DataFrame:
    """item and left, the number of items that follow it, of linked lists: links has item and next (null at the end).
    A list of n items takes log2(n) rounds, each one join; what leads into a circle has no end and is an error."""
    state = cut(links.select("item", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")))
    n = state.count()
    for _ in range(ceil(log2(n)) + 1 if n > 1 else 0):
        ahead = state.select(F.col("item").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        far = state.join(ahead, "next", "left")
        state = cut(far.select("item", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), state)
        if state.where("next is not null").isEmpty():
            break
    if not state.where("next is not null").isEmpty():
        raise RuntimeError("a list has no end")
    return state.drop("next")


def orient(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges with up and down instead of a and b, the end nearer to the root and the other. Edges have a and b and
    form trees with one root each; roots has node. Other columns stay."""
    kept = [c for c in edges.columns if c not in ("a", "b")]
    rows = cut(edges.withColumn("_e", F.monotonically_increasing_id()))
    out = rows.select((2 * F.col("_e")).alias("arc"), F.col("a").alias("node")).union(rows.select((2 * F.col("_e") + 1).alias("arc"), F.col("b").alias("node")))
    around = Window.partitionBy("node")
    turn = out.select("node", "arc", F.lead("arc").over(around.orderBy("arc")).alias("after"), F.min("arc").over(around).alias("first"))
    top = roots.select("node", F.lit(True).alias("_top")).distinct()
    after = F.when(F.col("after").isNull() & F.col("_top").isNull(), F.col("first")).otherwise(F.col("after"))
    # the arc in on an edge is its arc out with the last bit turned
    links = turn.join(top, "node", "left").select(F.col("arc").bitwiseXOR(F.lit(1)).alias("item"), after.alias("next"))
    left = ranks(links)
    sides = left.groupBy(F.shiftright("item", 1).alias("_e")).agg(F.max(F.struct("left", "item"))["item"].alias("_away"))
    there = F.col("_away") % 2 == 0
    return rows.join(sides, "_e").select(*kept, F.when(there, F.col("a")).otherwise(F.col("b")).alias("up"), F.when(there, F.col("b")).otherwise(F.col("a")).alias("down"))
