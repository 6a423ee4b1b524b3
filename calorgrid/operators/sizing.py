"""Diameters that depend on more than one pipe: components of one dn, and missing ones taken from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.functions import catalog
from calorgrid.operators import graph, intervals, tree
from calorgrid.operators.lineage import cut

SLACK = "0.000001"  # m
ASSUMED_DN = 300


def uplift(edges: DataFrame, rounds: int = 18) -> DataFrame:
    """Lift whole components of one dn whose pipes are together longer than the catalogue allows.

    edges has edge, a, b (nodes, strings), dn and length. Pipes that share a node and a dn are one component; if
    their lengths add up to more than the dn's limit, each goes up one step. Rounds follow until nothing changes.
    Adds lifted, and failed: whether a second step above its dn would be needed, which the rules forbid.
    """
    state = cut(edges.withColumns({"lifted": F.col("dn"), "failed": F.lit(False)}))
    for _ in range(rounds):
        # an edge meets others at keys of node and dn; components of edges and keys are the components wanted
        key = F.explode(F.array(F.concat_ws("@", "a", "lifted"), F.concat_ws("@", "b", "lifted")))
        meets = state.select(F.concat(F.lit("edge "), F.col("edge").cast("string")).alias("a"), key.alias("b"))
        label = graph.components(meets, meets.select(F.col("a").alias("node"))).select(F.expr("substr(node, 6)").alias("_edge"), "label")
        joined = state.join(label, F.col("edge").cast("string") == F.col("_edge")).drop("_edge")
        total = joined.groupBy("label").agg(F.sum("length").alias("_total"), F.first("lifted").alias("_dn"))
        limit = catalog.of_pipe(F.col("_dn"), "max_length", "decimal(18,9)") + F.lit(SLACK).cast("decimal(18,9)")
        over = cut(total.where(F.col("_total") > limit).select("label", F.lit(True).alias("_over")))
        if over.isEmpty():
            break
        new = joined.join(over, "label", "left").drop("label")
        first = F.col("_over") & (F.col("lifted") == F.col("dn")) & catalog.next_dn(F.col("lifted")).isNotNull()
        state = new.select(
            *[c for c in state.columns if c not in ("lifted", "failed")],
            F.when(first, catalog.next_dn(F.col("lifted"))).otherwise(F.col("lifted")).alias("lifted"),
            (F.col("failed") | F.coalesce(F.col("_over") & ~first, F.lit(False))).alias("failed"),
        )
        state = cut(state)
        if state.where("lifted <> dn and not failed").isEmpty():
            break
    return state


def _better(old: DataFrame, new: DataFrame) -> DataFrame:
    """like, dn and at of both, without rows of a `like` of which another says a dn as large as early; new is 1 where the
    row was not among the old."""
    rows = old.select("like", "dn", "at", F.lit(0).alias("new")).union(new.select("like", "dn", "at", F.lit(1)))
    rows = rows.groupBy("like", "dn").agg(F.min(F.struct("at", "new")).alias("_a")).select("like", "dn", "_a.*")
    wider = Window.partitionBy("like").orderBy(F.desc("dn")).rowsBetween(Window.unboundedPreceding, -1)
    return cut(rows.withColumn("_before", F.min("at").over(wider)).where("_before is null or at < _before").drop("_before"))


def propagate_dn(lines: DataFrame, touching: DataFrame) -> DataFrame:
    """Give lines without dn that of the lines that they touch: lines (id, dn), touching (a, b), both ways.

    Lines are taken in order of their ids, sweep after sweep; one is settled as soon as a line that it touches is
    known, also if that happened earlier in the sweep, and gets the largest dn of those known by then. What touches no
    known line gets ASSUMED_DN. Adds assumed: whether the dn was not given.

    Lines that touch the same ones and each other may share a name in a column `like`, and touching then has pairs of
    such names. A line is settled in the sweep of the first among those that it touches, if its id is greater, or in
    the next, so of a `like` the first line settled is all that others have to know; it is found by rounds of grouped
    minima. Of dn they have to know when a line of each dn is first settled, which rounds find in the same way.
    """
    if "like" not in lines.columns:
        lines = lines.withColumn("like", F.col("id"))
    rows = cut(lines.select("id", "like", "dn"))
    known, unknown = rows.where("dn is not null"), cut(rows.where("dn is null").select("like", "id"))
    within = rows.groupBy("like").agg(F.count("*").alias("n")).where("n > 1").select("like", F.col("like").alias("other"))
    pairs = cut(touching.select(F.col("a").alias("like"), F.col("b").alias("other")).where("like <> other").union(within).distinct())
    named = lambda sweep: F.struct(F.lit(sweep).alias("sweep"), F.col("id"))
    given = cut(known.groupBy("like").agg(F.max("dn").alias("dn"), F.min(named(0)).alias("at")))
    spread = lambda front, *by: pairs.join(front.withColumnRenamed("like", "other"), "other").groupBy("like", *by).agg(F.min("at").alias("at"))

    # by: the first that a line touches; at: the first line of a `like`
    first = cut(rows.select("like").distinct().join(given.select("like", "at"), "like", "left").select("like", F.lit(None).cast(given.schema["at"].dataType).alias("by"), "at"))
    front = first.where("at is not null")
    while True:  # each round goes on from what the last one moved
        met = spread(front.select("like", "at")).withColumnRenamed("at", "_by")
        met = cut(met.join(first, "like").where("by is null or _by < by").select("like", "_by"))
        after = F.col("id") > F.col("_by.id")
        at = F.when(F.col("_by.sweep") == 0, named(1)).when(after, F.struct(F.col("_by.sweep").alias("sweep"), "id")).otherwise(F.struct((F.col("_by.sweep") + 1).alias("sweep"), "id"))
        own = met.join(unknown, "like").groupBy("like").agg(F.min(at).alias("_at"))
        new = first.join(met, "like", "left").join(own, "like", "left")
        new = cut(new.select("like", F.least("by", "_by").alias("by"), F.least("at", "_at").alias("at"), F.coalesce(F.col("_at").isNotNull() & (F.col("at").isNull() | (F.col("_at") < F.col("at"))), F.lit(False)).alias("moved")))
        first, front = new.drop("moved"), new.where("moved")
        if front.isEmpty():
            break
    by = F.col("by")
    sweep = F.when(by["sweep"] == 0, 1).when(F.col("id") > by["id"], by["sweep"]).otherwise(by["sweep"] + 1)
    settled = cut(unknown.join(first.where("by is not null"), "like").select("like", F.struct(sweep.alias("sweep"), "id").alias("_own")))

    says, hears, front = given, given.where("false"), given
    while True:
        hears = _better(hears, spread(front, "dn"))
        own = hears.where("new = 1").join(settled, "like").where("_own > at").groupBy("like", "dn").agg(F.min("_own").alias("at"))
        says = _better(says, own)
        front = says.where("new = 1")
        if front.isEmpty():
            break
    best = settled.join(hears.drop("new"), "like").where("at < _own").groupBy(F.col("_own.id").alias("id")).agg(F.max("dn").alias("_dn"))
    found = rows.join(best, "id", "left")
    return found.select("id", F.coalesce("dn", "_dn", F.lit(ASSUMED_DN)).alias("dn"), F.col("dn").isNull().alias("assumed"))


def reconstruction(edges: DataFrame, ties: DataFrame) -> DataFrame:
    """The stretches of an existing forest that new consumers make too narrow: edge, a, b, added and new_dn (null where
    no row of the catalogue carries the flow).

    edges has edge, parent (the edge above), length, flow and dn; ties has edge, station (from the upper end) and
    flow. An edge carries in full what is tied in below it, which one climb sums up for all edges, and up to its
    station what is tied in on it, which a sweep over the stations of the edge adds; ways are never listed.
    """
    flow = "decimal(18,2)"
    own = ties.groupBy("edge").agg(F.sum("flow").cast(flow).alias("own"))
    rows = edges.select("edge", "parent").join(own, "edge", "left").withColumn("own", F.coalesce("own", F.lit(0).cast(flow)))
    below = tree.climb(rows.withColumn("all", F.col("own")), "edge", below={"all": "sum"}).select(F.col("node").alias("edge"), "all")
    passing = rows.join(below, "edge").join(edges.select("edge", "length"), "edge")
    # hundredths, as sums of long decimals are slow
    zone = lambda b, v: ("edge", F.lit(0).cast("long").alias("a"), F.col(b).cast("long").alias("b"), (F.col(v).cast(flow) * 100).cast("long").alias("v"))
    passing = passing.withColumn("rest", F.col("all") - F.col("own")).where("rest > 0 and length > 0").select(*zone("length", "rest"))
    # ties at one station are one zone before anything is swept
    tied = ties.where("station > 0").groupBy("edge", "station").agg(F.sum("flow").alias("flow")).where("flow > 0").select(*zone("station", "flow"))
    parts = intervals.interval_sum(passing.union(tied), "v", key="edge").withColumn("added", (F.col("total").cast("decimal(18,0)") / 100).cast(flow))
    joined = parts.join(edges.select("edge", F.col("flow").alias("_flow"), "dn"), "edge")
    # the flow is added up once, not for each row of the catalogue
    new_dn = F.transform(F.array((F.col("_flow") + F.col("added")).cast(flow)), catalog.base_dn)[0]
    narrow = joined.withColumn("new_dn", new_dn).where(F.coalesce(F.col("new_dn") > F.col("dn"), F.col("new_dn").isNull()))
    return narrow.select("edge", "a", "b", "added", "new_dn")
