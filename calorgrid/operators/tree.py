"""Trees given as node and parent: depths, roots, sums along and below, path diameters, degrees, cycles.

All of them climb by doubling: after k rounds a node points 2**k nodes up and knows what lies between. A tree of
any depth thus takes a logarithm of rounds, each two joins and one grouped sum of one row per node.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.functions import catalog
from calorgrid.operators.lineage import cut


def climb(
    nodes: DataFrame,
    node: str = "node",
    parent: str = "parent",
    along: dict[str, str] | None = None,
    below: dict[str, str] | None = None,
) -> DataFrame:
    """node, parent, root and depth of all nodes that a root (without parent) reaches, and per node each column of
    `along` as the sum or max (what the dict says) over the way from the root, each of `below` over what hangs on
    it, itself included in both, in the type of the column. Nodes on cycles, nodes whose parent is no row, and all
    below them are left out; a node of two parents is an error.
    """
    along, below = along or {}, below or {}
    values = [*along, *below]
    start = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *values)
    start = cut(start.withColumns({"up": F.col("parent"), "root": F.col("node"), "depth": F.lit(0)}))
    n, one = start.agg(F.count("*"), F.count_distinct("node")).first()
    if one < n:
        raise RuntimeError("a node has two parents")
    state, written = start.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)), start
    pick = {"sum": lambda a, b: a + b, "max": F.greatest}
    for k in range(ceil(log2(n + 1)) + 1 if n else 0):
        if state.where("up is not null").isEmpty():
            break
        high = state.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"),
            F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in along],
        )
        new = state.join(high, "up", "left")
        low = state.where("up is not null").groupBy(F.col("up").alias("node"))
        if below:
            new = new.join(low.agg(*[getattr(F, how)(c).alias(f"_{c}") for c, how in below.items()]), "node", "left")
        met = F.col("up").isNotNull()
        kind = dict(state.dtypes)
        state = new.select(
            "node", "parent", F.col("_up").alias("up"),
            F.when(met, F.col("_root")).otherwise(F.col("root")).alias("root"),
            F.when(met, F.col("depth") + F.coalesce("_depth", F.lit(0))).otherwise(F.col("depth")).cast("int").alias("depth"),
            *[F.coalesce(pick[how](F.col(c), F.col(f"_{c}")), F.col(c)).cast(kind[c]).alias(c) for c, how in [*along.items(), *below.items()]],
        )
        state = written = cut(state, written)
    return state.where("up is null and root is not null").select("node", "parent", "root", "depth", *values)


def levels(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, parent and depth of all nodes that a root reaches."""
    return climb(nodes, node, parent).drop("root")


def roll_up(nodes: DataFrame, value: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, parent, depth and total: the sum of a value over the node and all below it."""
    return climb(nodes, node, parent, below={value: "sum"}).drop("root").withColumnRenamed(value, "total")


def fitting_dn(flow: Column, least: Column, length: Column, tail) -> Column:
    """dn and tail of the least catalogue row that carries a flow, is no less than `least`, and whose run, `length`
    with the longest run of that dn below (`tail` of the dn), keeps within the row's length; null if none does."""
    options = []
    for p in catalog.PIPES:
        whole = (length + F.coalesce(tail(p[0]), F.lit(0))).cast("decimal(18,9)")
        fits = (F.lit(p[0]) >= F.greatest(catalog.base_dn(flow), least)) & (whole <= F.lit(p[2]).cast("decimal(18,9)"))
        options.append(F.when(fits, F.struct(F.lit(p[0]).alias("dn"), whole.alias("tail"))))
    return F.coalesce(*options)


def path_dn(edges: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """One level of path diameters, from the leaves up: edges with edge, flow and length get dn and tail.

    children has edge (the edge above), dn and tail of the level below; of each dn only its longest tail counts,
    so an edge meets one row of at most 18 tails.
    """
    if children is None:
        pick = fitting_dn(F.col("flow"), F.lit(0), F.col("length"), lambda dn: F.lit(None).cast("decimal(18,9)"))
        return edges.withColumn("_pick", pick).select(*edges.columns, "_pick.dn", "_pick.tail")
    tails = [F.max(F.when(F.col("dn") == p[0], F.col("tail"))).alias(f"_t{p[0]}") for p in catalog.PIPES]
    joined = edges.join(children.groupBy("edge").agg(F.max("dn").alias("_max"), *tails), "edge", "left")
    pick = fitting_dn(F.col("flow"), F.coalesce("_max", F.lit(0)), F.col("length"), lambda dn: F.col(f"_t{dn}"))
    return joined.withColumn("_pick", pick).select(*edges.columns, "_pick.dn", "_pick.tail")


def runs(edges: DataFrame) -> DataFrame:
    """edge, run: edges of equal flow that follow each other without a branch or a demand between are one run,
    named by its upper edge. edges has edge, parent (the edge above) and flow."""
    below = edges.where("parent is not null").groupBy(F.col("parent").alias("edge")).agg(F.count("*").alias("_n"), F.max("flow").alias("_flow"))
    on = edges.join(below, "edge", "left").select(F.col("edge").alias("parent"), (F.col("_n") == 1).alias("_one"), F.col("flow").alias("_flow"))
    same = edges.join(on, "parent", "left").select("edge", F.when(F.col("_one") & (F.col("flow") == F.col("_flow")), F.col("parent")).alias("parent"))
    return climb(same, "edge").select(F.col("node").alias("edge"), F.col("root").alias("run"))


def path_diameters(edges: DataFrame) -> DataFrame:
    """edge, flow, dn and tail of the edges of forests: edge, parent, length and the demand at its lower end.

    The flow of an edge is all demand below. Edges of one flow form runs; runs are sized from the leaves up, one
    join per level of runs, so that dn never grows away from the root and sibling branches don't add up. The dn is
    null where no row of the catalogue fits, and above such a run.
    """
    flow = climb(edges, "edge", below={"demand": "sum"}).select(F.col("node").alias("edge"), "parent", F.col("demand").alias("flow"))
    rows = cut(flow.join(edges.select("edge", "length"), "edge").withColumn("flow", F.col("flow").cast("decimal(12,2)")))
    rows = cut(rows.join(runs(rows), "edge"))
    one = rows.groupBy("run").agg(F.sum("length").cast("decimal(18,9)").alias("length"), F.max("flow").alias("flow"))
    top = rows.where("edge = run").select("run", F.col("parent").alias("edge"))
    above = top.join(rows.select("edge", F.col("run").alias("above")), "edge", "left").select("run", "above")
    tree = one.join(above, "run")
    depth = climb(tree, "run", "above").select(F.col("node").alias("run"), "depth")
    tree = cut(tree.join(depth, "run").select(F.col("run").alias("edge"), "above", "flow", "length", "depth"))
    last, found = None, None
    for d in range(tree.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = tree.where(F.col("depth") == d)
        sized = cut(path_dn(level, last))
        last = sized.select(F.col("above").alias("edge"), F.coalesce("dn", F.lit(1 << 30)).alias("dn"), F.coalesce("tail", F.lit(0)).alias("tail"))
        found = sized if found is None else found.union(sized)
    sizes = found.select(F.col("edge").alias("run"), "dn", "tail") if found is not None else rows.select("run", F.lit(None).cast("int").alias("dn"), F.lit(None).cast("decimal(18,9)").alias("tail"))
    return rows.join(sizes, "run").select("edge", "flow", "dn", "tail")


def degree(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node and degree over tree edges: one at each end."""
    edges = nodes.where(F.col(parent).isNotNull())
    return edges.select(F.explode(F.array(node, parent)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def orphans(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Rows whose parent is no node."""
    return nodes.where(F.col(parent).isNotNull()).join(nodes.select(F.col(node).alias("_n")), F.col(parent) == F.col("_n"), "left_anti")
