"""The graph of an existing network: nodes from near ends, edges between stations, components and their kinds."""

from __future__ import annotations

from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.operators import graph, intervals, spatial, tree
from calorgrid.operators.lineage import cut

SNAP = 0.1  # m
TILES = (64, 16)  # sides of the tiles in which points are snapped in order, in snaps
MAX_PAIRS = 1 << 19  # of near points that one tile may take; where one has more, rounds of joins settle them


def snap_points(points: DataFrame, snap: float = SNAP, cell: int = 10, key: str = "scene_id") -> DataFrame:
    """The node of each point: points has the key, k (their order), x, y and anchor (a name, or null).

    In their order points join the first node whose centre, its first point, is within `snap`, if no point that has
    joined it before is farther away than that and their anchors don't differ; else they become a node. So a and c
    may stay apart though b is near both. A point depends on earlier ones within twice the distance only: in each
    round all are settled whose earlier neighbours are, however many scenes there are; a tile of neighbours settles many rounds at once.

    Points of one place and anchor are one: the first of them. Those after it join its node, as all others in it are
    near them too, and no node before it that was full for the first takes them later; nor do they keep others out.
    """
    given = cut(points.select(key, "k", "x", "y", "anchor"))
    real = F.col(key).isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")) & F.col("x").isNotNull() & F.col("y").isNotNull()
    placed = given.where(F.coalesce(real, F.lit(False)))
    first = cut(placed.groupBy(key, "x", "y", "anchor").agg(F.min("k").alias("k")))
    node = _snapped(first, snap, cell, key)
    same = (placed["x"] == first["x"]) & (placed["y"] == first["y"]) & placed["anchor"].eqNullSafe(first["anchor"]) & (placed[key] == first[key])
    of = placed.join(first.withColumnRenamed("k", "_first"), same).select(placed[key], placed["k"], "_first")
    found = of.join(node.withColumnRenamed("k", "_first"), [key, "_first"]).select(key, "k", "node")
    return found.union(given.where(~F.coalesce(real, F.lit(False))).select(key, "k", F.col("k").alias("node")))


def _snapped(p: DataFrame, snap: float, cell: int, key: str) -> DataFrame:
    o = p.select(key, *[F.col(c).alias(f"o_{c}") for c in ("k", "x", "y", "anchor")])
    at = lambda a, b, m: (F.col(a) - m, F.col(b) - m, F.col(a) + m, F.col(b) + m)
    pairs = spatial.near(p, o, at("x", "y", 2 * snap), at("o_x", "o_y", 0), cell, [key]).where("o_k < k")
    pairs = pairs.withColumn("d", F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y"))).where(F.col("d") <= 2 * snap)
    same = F.col("anchor").isNull() | F.col("o_anchor").isNull() | (F.col("anchor") == F.col("o_anchor"))
    pairs = cut(pairs.select(key, "k", "o_k", "x", "y", (F.col("d") <= snap).alias("fits"), same.alias("same")))
    done = cut(p.select(key, "k").join(pairs.select(key, "k").distinct(), [key, "k"], "left_anti").withColumn("node", F.col("k")))
    sides = [t * snap for t in TILES if _densest(pairs, key, t * snap) <= MAX_PAIRS]
    kind = dict(p.dtypes)
    for n in count():
        met = pairs.join(done.select(key, F.col("k").alias("o_k"), "node"), [key, "o_k"], "left")
        if sides:  # tiles in four turns, so what lies on the border of one lies within another
            sx, sy = ((0, 0), (1, 1), (1, 0), (0, 1))[n % 4]
            tiles = met.withColumns({"_tx": F.floor(F.col("x") / sides[0] + sx / 2), "_ty": F.floor(F.col("y") / sides[0] + sy / 2)}).drop("x", "y")
            new = tiles.groupBy(key, "_tx", "_ty").applyInArrow(lambda t: _settled(t, key), f"`{key}` {kind[key]}, k {kind['k']}, node {kind['k']}")
        else:
            ready = met.groupBy(key, "k").agg(F.bool_and(F.col("node").isNotNull()).alias("ready")).where("ready").select(key, "k")
            centre = F.max(F.when(F.col("o_k") == F.col("node"), F.col("same")))
            nodes = met.join(ready, [key, "k"], "left_semi").groupBy(key, "k", "node").agg(F.min("fits").alias("fits"), centre.alias("same")).where("fits and same")
            new = ready.join(nodes.groupBy(key, "k").agg(F.min("node").alias("node")), [key, "k"], "left").select(key, "k", F.coalesce("node", "k").alias("node"))
        new = cut(new)
        if new.isEmpty():
            return done
        done = cut(done.union(new))
        pairs = cut(pairs.join(new.select(key, "k"), [key, "k"], "left_anti"))


def _densest(pairs: DataFrame, key: str, side: float) -> int:
    """The most pairs in a tile, wherever the tiles begin: up to four of their neighbours may come together."""
    tiles = pairs.groupBy(key, F.floor(F.col("x") / side), F.floor(F.col("y") / side)).agg(F.count("*").alias("n"))
    return 4 * (tiles.agg(F.max("n")).first()[0] or 0)


def _settled(rows: pa.Table, key: str) -> pa.Table:
    """k and node of the points of a tile whose earlier neighbours have a node or get one here."""
    near: dict = {}
    for r in rows.drop_columns([key]).to_pylist():
        near.setdefault(r["k"], []).append(r)
    nodes: dict = {}
    for k in sorted(near):
        fits, same = {}, {}
        for r in near[k]:
            node = r["node"] if r["node"] is not None else nodes.get(r["o_k"])
            if node is None:
                break
            fits[node] = fits.get(node, True) and r["fits"]
            if r["o_k"] == node:
                same[node] = r["same"]
        else:
            nodes[k] = min((n for n in fits if fits[n] and same.get(n)), default=k)
    scene = rows[key][0].as_py()
    types = {c: rows.schema.field(c).type for c in (key, "k")}
    return pa.table({key: pa.array([scene] * len(nodes), types[key]), "k": pa.array(list(nodes), types["k"]), "node": pa.array(list(nodes.values()), types["k"])})


def edges_at(lines: DataFrame, marks: DataFrame, key: str = "line") -> DataFrame:
    """The stretches of lines between their marks: key, a, b, u, v. lines has key and length, marks key, s and node;
    of marks at one station the last node counts, and stations nearer than 1e-8 are one."""
    ends = lines.select(key, F.explode(F.array(F.lit(0).cast("double"), F.col("length").cast("double"))).alias("s"), F.lit(None).cast("string").alias("node"))
    rows = ends.union(marks.join(lines.select(key, "length"), key).where("s between 0 and length").select(key, F.col("s").cast("double"), "node"))
    at = rows.groupBy(key, F.round("s", 8).alias("s")).agg(F.max("node").alias("node"))
    name = lambda node, s: F.coalesce(node, F.concat_ws("@", F.col(key).cast("string"), F.col(s).cast("string"))).alias(node)
    nexts = intervals.sweep(at.select(key, F.col("s").alias("a"), F.col("node").alias("u")), [key], ["a"], nexts={"b": "a", "v": "u"}).where("b is not null")
    return nexts.select(key, "a", "b", name("u", "a"), name("v", "b"))


def edge_of(edges: DataFrame, probes: DataFrame, key: str = "line") -> DataFrame:
    """The edge at each station (key, s): the first that holds it, ends included.

    Edges and stations are shuffled once, by wide bins; an edge is put into each that it meets. An edge counts beyond
    the ends of those before it only, so the edge of a station is the one that ends next, if it has begun by then.
    """
    bins = lambda c: F.floor(F.col(c) / intervals.WIDE).cast("long")
    e = edges.where(F.col(key).isNotNull()).where("a <= b").select(key, F.explode(F.sequence(bins("a"), bins("b"))).alias("_bin"), F.lit(None).cast(dict(probes.dtypes)["s"]).alias("s"), "a", "b", "u", "v")
    p = probes.where(F.col(key).isNotNull()).where("s is not null").select(key, bins("s").alias("_bin"), "s", *[F.lit(None).cast(t).alias(c) for c, t in edges.dtypes if c in "abuv"])
    of = Window.partitionBy(key, "_bin")
    before = F.max("b").over(of.orderBy("a", "b", "u", "v").rowsBetween(Window.unboundedPreceding, -1))
    rows = e.unionByName(p).withColumn("_top", before)
    back = of.orderBy(F.coalesce("s", "b").desc(), F.col("s").isNotNull())
    edge = F.when(F.col("s").isNull() & F.coalesce(F.col("_top") < F.col("b"), F.lit(True)), F.struct("a", "b", "u", "v"))
    rows = rows.withColumns({"_e": F.last(edge, True).over(back), "_again": F.lag("s").over(back) == F.col("s")})
    return rows.where("s is not null and _e.a <= s and not coalesce(_again, false)").select(key, "s", "_e.*")


def components(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """label, nodes, edges, sources and ambiguous of each component: ambiguous unless it is a tree with one source.
    edges has a and b, sources has node."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(graph.components(edges, nodes))
    stats = label.join(sources.select("node", F.lit(1).alias("_source")).distinct(), "node", "left").groupBy("label").agg(F.count("*").alias("nodes"), F.count("_source").alias("sources"))
    count = edges.join(label, edges["a"] == label["node"]).groupBy("label").agg(F.count("*").alias("edges"))
    found = stats.join(count, "label")
    return found.select("label", "nodes", "edges", "sources", ((F.col("edges") != F.col("nodes") - 1) | (F.col("sources") != 1)).alias("ambiguous"))


def eligible(chambers: DataFrame, edges: DataFrame) -> DataFrame:
    """Chambers (node, dn) that can take a pipe: on the network, with fewer than four edges and a known dn."""
    rays = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("rays"))
    return chambers.join(rays, "node").where("rays < 4 and dn > 0")


def runs(lines: DataFrame, technical: DataFrame) -> DataFrame:
    """line and run, the least line of the chain that technical nodes with two ends make of lines (line, u, v)."""
    ends = lines.select("line", F.explode(F.array("u", "v")).alias("node")).join(technical.select("node"), "node", "left_semi")
    joints = ends.groupBy("node").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).where("n = 2 and a <> b")
    found = graph.components(joints.select("a", "b"), lines.select(F.col("line").alias("node")))
    return found.select(F.col("node").alias("line"), F.col("label").alias("run"))


def prune(nodes: DataFrame) -> DataFrame:
    """node, parent and demand of what is left of trees when branches without demand go and nodes in the middle of a
    way are merged into it: nodes has node, parent and demand. One climb finds the demand below; what stays and has
    one child and no demand of its own hands its child on, along whole chains at once."""
    carried = tree.climb(nodes.withColumn("below", F.col("demand")), below={"below": "sum"}).where("below > 0 or parent is null").select("node", "parent")
    kept = cut(carried.join(nodes.select("node", "demand"), "node"))
    children = kept.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    passes = kept.join(children, "node", "left").select("node", "parent", "demand", (F.col("parent").isNotNull() & (F.coalesce("children", F.lit(0)) == 1) & (F.col("demand") == 0)).alias("passes"))
    passes = cut(passes)
    # nodes that are passed hang on their parents, others are roots of their chains: the root above is the new parent
    hung = passes.select("node", F.when(F.col("passes"), F.col("parent")).alias("up"))
    top = tree.climb(hung, "node", "up").select(F.col("node").alias("parent"), F.col("root").alias("_top"))
    return passes.where("not passes").join(top, "parent", "left").select("node", F.col("_top").alias("parent"), "demand")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes that an edge (a, b) leads to and none leads on from."""
    return edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")


def depths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, depth and parent (the least of those one step nearer) by breadth from the sources. A round per step, which
    reads and writes its fronts only."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    start = sources.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["a"]).alias("parent"))
    # a neighbour of the front lies in it, one step nearer or one farther: the two last fronts tell which is new
    fronts, before = [cut(start)], None
    while True:
        front = fronts[-1]
        step = front.select(F.col("node").alias("a"), (F.col("depth") + 1).alias("depth")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("depth").alias("depth"), F.min("a").alias("parent"))
        known = front.select("node") if before is None else front.select("node").union(before.select("node"))
        new = cut(step.join(known, "node", "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.union, fronts)
        before = front
        fronts.append(new)


def best_of(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group, with their rank; Spark limits within tasks before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
