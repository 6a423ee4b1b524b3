"""Shared forests: pipes that grow by cheapest insertion, in all scenes and restarts at once.

A demand can join by a way of its own from a root, or by a branch that leaves a pipe at a right angle where a new
chamber is set. In each round every open demand knows its cheapest way in. It waits if a cheaper one's new pipe could
serve it for less, and of those that want the same pipe or root the cheapest is taken; the others ask again. What is
taken in one round in order of cost is thus what inserting one after the other would give: no insertion makes
another of its round cheaper. A round costs joins of the open demands with the new pipes only; the cheapest demand
of a scene never waits, so each round takes one of every scene at least, and as many as do not disturb each other.

Ways that cannot undercut a demand's cheapest are dropped by their lower bound before they meet any object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorgrid.functions import catalog, geometry, pricing
from calorgrid.operators import search, spatial, tree
from calorgrid.operators.lineage import cut

BRANCH_PRICE = 3_000_000.0  # fixed value: a chamber on a new pipe
END_RUN = 2.0  # m of pipe that stay on both sides of a branch
CELL = 500
KEY = ["scene_id", "restart"]
WAY = (*KEY, "demand", "kind", "target", "qx", "qy", "cost", "length")
PIPE = (*KEY, "pipe", "upper", "lower", "ux", "uy", "vx", "vy")


def _branches(open_: DataFrame, pipes: DataFrame, walls: DataFrame, which: Column) -> DataFrame:
    """Ways from open demands (with best, the cost of their cheapest way) to the interiors of pipes, as WAY; `which`
    tells the pairs that count."""
    reach = (F.col("best") - BRANCH_PRICE) / F.col("price")
    ends = [f(c(f"u{a}", f"v{a}")).alias(f"_{a}{k}") for a in "xy" for k, f, c in ((1, F.min, F.least), (2, F.max, F.greatest))]
    some = open_.where(reach > 0).withColumn("_r", reach).join(pipes.groupBy(*KEY).agg(*ends), KEY)
    # no farther than the scene's pipes lie
    low, high = ([f(F.col(a) + sign * F.col("_r"), F.col(f"_{a}{k}")) for a in "xy"] for f, sign, k in ((F.greatest, -1, 1), (F.least, 1, 2)))
    some = some.where((low[0] <= high[0]) & (low[1] <= high[1]))
    box = (*low, *high)
    side = (F.least("ux", "vx"), F.least("uy", "vy"), F.greatest("ux", "vx"), F.greatest("uy", "vy"))
    pairs = spatial.near(some, pipes, box, side, CELL, KEY).where(which)
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    whole = F.hypot(dx, dy)
    pairs = pairs.withColumns({"_whole": whole, "_s": ((F.col("x") - F.col("ux")) * dx + (F.col("y") - F.col("uy")) * dy) / whole})
    pairs = pairs.where((F.col("_s") >= END_RUN) & (F.col("_s") <= F.col("_whole") - END_RUN))
    t = F.col("_s") / F.col("_whole")
    pairs = pairs.withColumns({"rx": F.col("ux") + t * dx, "ry": F.col("uy") + t * dy})
    pairs = pairs.withColumn("length", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")))
    least = F.col("price") * F.col("length") + BRANCH_PRICE
    pairs = pairs.where((F.col("length") > 0.1) & (least < F.col("best"))).withColumn("way", F.struct(*KEY, "demand", "pipe"))
    return search.passable(pairs, walls).withColumn("cost", F.round(F.col("cost") + BRANCH_PRICE, 2)).where("cost < best").select(
        *KEY, "demand", F.lit("branch").alias("kind"), F.col("pipe").alias("target"), F.col("rx").alias("qx"), F.col("ry").alias("qy"), "cost", "length"
    )


def _best(ways: DataFrame) -> DataFrame:
    """The cheapest way of each demand, as WAY."""
    pick = F.min(F.struct("cost", "kind", "target", "qx", "qy", "length")).alias("w")
    return ways.groupBy(*KEY, "demand").agg(pick).select(*KEY, "demand", "w.*").select(*WAY)


def _waiting(asks: DataFrame) -> DataFrame:
    """KEY and demand of those that a cheaper demand's new pipe could serve for less: asks is WAY with x, y, price."""
    r = (F.col("cost") - BRANCH_PRICE) / F.col("price")
    d = asks.where(r > 0).withColumn("_r", r)
    box = tuple(F.col(c) + s * F.col("_r") for c, s in (("x", -1), ("y", -1), ("x", 1), ("y", 1)))
    o = asks.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("demand", "cost", "x", "y", "qx", "qy")])
    side = tuple(f(f"o_{a}", f"o_{b}") for f, a, b in ((F.least, "x", "qx"), (F.least, "y", "qy"), (F.greatest, "x", "qx"), (F.greatest, "y", "qy")))
    pairs = spatial.near(d, o, box, side, CELL, KEY).where(F.struct("o_cost", "o_demand") < F.struct("cost", "demand"))
    away = geometry.distance(*[F.col(c) for c in ("x", "y", "o_x", "o_y", "o_qx", "o_qy")])
    return pairs.where(F.col("price") * away + BRANCH_PRICE < F.col("cost")).select(*KEY, "demand").distinct()


def _waiting_for_roots(asks: DataFrame, unused: DataFrame) -> DataFrame:
    """KEY and demand of those that would rather join a root without a tie-in (unused: their ways there, the tie-in
    not in the cost), once a cheaper demand has paid for it."""
    wants = unused.select(*KEY, "demand", F.col("target").alias("o_root"), F.col("cost").alias("_plain")).join(asks.select(*KEY, "demand", "cost"), [*KEY, "demand"])
    pays = asks.where("kind = 'root'").select(*KEY, F.col("target").alias("o_root"), F.col("demand").alias("o_demand"), F.col("cost").alias("o_cost"))
    first = pays.groupBy(*KEY, "o_root").agg(F.min(F.struct("o_cost", "o_demand")).alias("_first"))
    met = wants.where("_plain < cost").join(first, [*KEY, "o_root"])
    return met.where(F.col("_first") < F.struct(F.col("cost").alias("o_cost"), F.col("demand").alias("o_demand"))).select(*KEY, "demand")


def grow(demands: DataFrame, roots: DataFrame, walls: DataFrame, restarts: int = 1, seed: int = 1, spread: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The pipes of all forests (PIPE, nodes named by what they are) and the ways taken in their order (WAY with turn).

    demands, roots and walls as in `search.routes`. Restart 0 takes the costs as they are; in the others the ways from
    roots ask as if they cost up to `spread` more, so that other demands come first.
    """
    direct = search.portfolio(search.routes(demands, roots, walls), restarts, seed, spread)
    # a tie-in is paid once; a root that has one is cheaper for those that come later
    direct = cut(direct.join(roots.select("scene_id", "root", F.col("rx").alias("qx"), F.col("ry").alias("qy")), ["scene_id", "root"]).select(*KEY, "demand", F.lit("root").alias("kind"), F.col("root").cast("string").alias("target"), "qx", "qy", "cost", "length", "free"))
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)").cast("double")
    left = demands.withColumn("dn", catalog.base_dn(F.col("flow").cast("decimal(12,2)"))).where("dn is not null")
    left = left.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    everyone = cut(left.select(*KEY, "demand", "x", "y", "dn", "flow", price.alias("price"), F.concat(F.lit("demand "), F.col("demand").cast("string")).alias("lower")))
    branches = cut(direct.select(*WAY).where("false"))
    pipes = cut(everyone.select(*KEY, F.lit("").alias("pipe"), F.lit("").alias("upper"), "lower", *[F.lit(0.0).alias(c) for c in PIPE[5:]], F.lit(0).alias("turn")).where("false"))
    turns, turn = [], 0
    while True:
        turn += 1
        # rays and open demands follow from the pipes that stand
        used = pipes.where(F.startswith("upper", F.lit("root "))).groupBy(*KEY, F.substring("upper", 6, 1 << 20).alias("target")).agg(F.count("*").alias("rays"))
        left = everyone.join(pipes.select(*KEY, "lower"), [*KEY, "lower"], "left_anti").drop("lower")
        rays = direct.join(used, [*KEY, "target"], "left").withColumn("rays", F.coalesce("rays", F.lit(0)))
        tie = F.when(F.col("rays") == 0, float(catalog.TIE_IN_PRICE)).otherwise(0.0)
        from_roots = rays.where("rays < free").withColumn("cost", F.col("cost") + tie).select(*WAY)
        asks = cut(_best(from_roots.union(branches)).join(left, [*KEY, "demand"]))
        waiting = _waiting(asks).union(_waiting_for_roots(asks, rays.where("rays = 0 and free > 0"))).distinct()
        ready = asks.join(waiting, [*KEY, "demand"], "left_anti")
        first = Window.partitionBy(*KEY, "kind", "target").orderBy("cost", "demand")
        taken = cut(ready.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("turn", F.lit(turn)))
        if taken.isEmpty():
            break
        turns.append(taken)
        name = F.col("demand").cast("string")
        way = taken.select(*KEY, name.alias("pipe"), F.when(F.col("kind") == "root", F.concat(F.lit("root "), "target")).otherwise(F.concat(name, F.lit("*"))).alias("upper"), F.concat(F.lit("demand "), name).alias("lower"), F.col("qx").alias("ux"), F.col("qy").alias("uy"), F.col("x").alias("vx"), F.col("y").alias("vy"))
        split = taken.where("kind = 'branch'").select(*KEY, F.col("target").alias("pipe"), name.alias("by"), "qx", "qy")
        halves, chamber = pipes.join(split, [*KEY, "pipe"]), F.concat("by", F.lit("*"))
        above = halves.select(*KEY, F.concat("by", F.lit("<")).alias("pipe"), "upper", chamber.alias("lower"), "ux", "uy", F.col("qx").alias("vx"), F.col("qy").alias("vy"))
        below = halves.select(*KEY, F.concat("by", F.lit(">")).alias("pipe"), chamber.alias("upper"), "lower", F.col("qx").alias("ux"), F.col("qy").alias("uy"), "vx", "vy")
        gone = split.select(*KEY, "pipe")
        new = way.union(above).union(below).withColumn("turn", F.lit(turn))
        pipes = cut(pipes.join(gone, [*KEY, "pipe"], "left_anti").select(*PIPE, "turn").union(new), pipes)
        still = asks.join(taken.select(*KEY, "demand"), [*KEY, "demand"], "left_anti")
        # what a demand's cheapest way was can be lost with a full root or a cut pipe: then all pipes are open to it again
        cut_off = gone.select(*KEY, F.lit("branch").alias("kind"), F.col("pipe").alias("target"))
        met = taken.where("kind = 'root'").select(*KEY, F.lit("root").alias("kind"), "target").distinct()
        lost = cut_off.union(met).withColumn("_lost", F.lit(True))
        bound = still.select(*KEY, "demand", "x", "y", "dn", "flow", "price", F.col("cost").alias("best"), "kind", "target").join(lost, [*KEY, "kind", "target"], "left")
        unmet = everyone.join(pipes.select(*KEY, "lower"), [*KEY, "lower"], "left_anti").join(asks.select(*KEY, "demand"), [*KEY, "demand"], "left_anti")
        bound = bound.select(*KEY, "demand", "x", "y", "dn", "flow", "price", "best", F.coalesce("_lost", F.lit(False)).alias("_lost"))
        bound = bound.union(unmet.select(*KEY, "demand", "x", "y", "dn", "flow", "price", F.lit(0.0), F.lit(True))).withColumn("best", F.when(F.col("_lost"), F.lit(1e12)).otherwise(F.col("best")))
        # the new pipes alone for those whose way stands, all of them for the others
        more = _branches(bound, pipes.withColumnRenamed("turn", "_turn"), walls, F.col("_lost") | (F.col("_turn") == turn))
        old = branches.join(gone.withColumnRenamed("pipe", "target"), [*KEY, "target"], "left_anti").join(still.select(*KEY, "demand"), [*KEY, "demand"], "left_semi").select(*WAY)
        branches = cut(old.union(more).distinct(), branches)
    ways = reduce(DataFrame.union, turns) if turns else asks.withColumn("turn", F.lit(0))
    return pipes.select(*PIPE), ways.select(*WAY, "turn")


def priced(pipes: DataFrame, demands: DataFrame) -> DataFrame:
    """Pipes with parent, length, flow, dn and cost: what each carries and the least diameter that may carry it."""
    name = lambda c: F.concat_ws(" ", "scene_id", "restart", c)
    need = demands.select("scene_id", F.concat(F.lit("demand "), F.col("demand").cast("string")).alias("lower"), F.col("flow").cast("decimal(18,2)").alias("demand"))
    rows = pipes.join(need, ["scene_id", "lower"], "left").join(pipes.select(*KEY, F.col("lower").alias("upper"), F.col("pipe").alias("above")), [*KEY, "upper"], "left")
    rows = cut(rows.withColumns({"edge": name("pipe"), "parent": F.when(F.col("above").isNotNull(), name("above")), "demand": F.coalesce("demand", F.lit(0)).cast("decimal(18,2)"), "length": F.round(F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")), 9).cast("decimal(18,9)")}))
    sized = tree.path_diameters(rows.select("edge", "parent", "length", "demand"))
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)")
    return rows.drop("demand").join(sized, "edge").withColumn("cost", pricing.piece_cost(F.col("length"), price, F.lit(1)))


def layouts(demands: DataFrame, roots: DataFrame, walls: DataFrame, restarts: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The cheapest forest of each scene: its pipes, and a row with what it connects, carries and costs, penalties of the
    unconnected included; a forest with a pipe that no diameter fits comes last."""
    pipes, ways = grow(demands, roots, walls, restarts, seed)
    sized = cut(priced(pipes, demands))
    lines = sized.groupBy(*KEY).agg(F.sum("cost").cast("decimal(20,2)").alias("pipes"), F.sum("length").cast("decimal(18,9)").alias("length"), F.max(F.col("dn").isNull()).alias("unfit"))
    set_ = ways.groupBy(*KEY).agg(F.count("*").alias("connected"), F.count_distinct(F.when(F.col("kind") == "root", F.col("target"))).alias("ties"), F.count(F.when(F.col("kind") == "branch", 1)).alias("chambers"))
    every = demands.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    lost = every.join(ways.select(*KEY, "demand"), [*KEY, "demand"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("missing"), F.sum(pricing.penalty(F.col("flow"))).alias("penalty"))
    rows = every.select(*KEY).distinct().join(lines, KEY, "left").join(set_, KEY, "left").join(lost, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cost = (zero("pipes") + zero("ties") * catalog.TIE_IN_PRICE + zero("chambers") * int(BRANCH_PRICE) + zero("penalty")).cast("decimal(20,2)")
    rows = rows.select(*KEY, *[zero(c).alias(c) for c in ("connected", "missing", "ties", "chambers")], F.coalesce("unfit", F.lit(False)).alias("unfit"), zero("length").cast("decimal(18,9)").alias("length"), cost.alias("cost"))
    first = Window.partitionBy("scene_id").orderBy("unfit", "missing", "cost", "restart")
    best = cut(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    return sized.join(best.select(*KEY), KEY, "left_semi"), best
