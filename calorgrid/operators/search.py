"""Search for layouts as Spark jobs: candidates, assignment to roots, exact covers, distance fields, portfolios.

One row is a choice of one scene (and one restart of it), so that thousands of scenes and restarts are searched side
by side; a round is a join and a grouped choice. What a plan needs that only a long program on one machine gives,
such as bending routes around obstacles point by point, is left out (see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from calorgrid.functions import catalog, geometry, pricing
from calorgrid.operators import network, spatial
from calorgrid.operators.lineage import cut

RAYS = 4
CELL = 100


def stream(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for a restart: a hash of the seed and of what tells the stream from others."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def routes(demands: DataFrame, roots: DataFrame, walls: DataFrame, most: int = 8) -> DataFrame:
    """Straight ways from each demand to its `most` nearest roots that the rules allow, with length, dn and cost.

    demands has scene_id, demand, x, y and flow; roots scene_id, root, rx, ry and free (rays that it can take); walls
    scene_id, wall, kind, x1, y1, x2, y2. A way that meets an object which must not be crossed, or crosses a road
    or tracks at less than 45 degrees, is left out; each special object crossed costs its factor on the stretch that
    it asks for.
    """
    named = demands.withColumn("point", F.struct("scene_id", "demand"))
    pairs = _nearest(named, roots, most)
    dn = catalog.base_dn(F.col("flow").cast("decimal(12,2)"))
    length = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    pairs = cut(pairs.withColumns({"dn": dn, "length": length}).where("dn is not null and length > 0"))
    ways = passable(pairs.withColumn("way", F.struct("scene_id", "demand", "root")), walls)
    return ways.select("scene_id", "demand", "root", "flow", "dn", "length", "free", "cost")


def passable(ways: DataFrame, walls: DataFrame) -> DataFrame:
    """Of straight ways (way, scene_id, x, y to rx, ry, dn, length) those that the walls allow, with their cost."""
    box = lambda a, b, c, d: (F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))
    lines = ways.select("way", "scene_id", "x", "y", "rx", "ry")
    hit = spatial.near(lines, walls, box("x", "y", "rx", "ry"), box("x1", "y1", "x2", "y2"), CELL, ["scene_id"])
    p = lambda x, y: (F.col(x), F.col(y))
    quad = (p("x", "y"), p("rx", "ry"), p("x1", "y1"), p("x2", "y2"))
    hit = hit.where(geometry.crosses(*quad)).withColumn("steep", geometry.steep(*quad))
    special = F.col("kind").isin(*catalog.FACTOR)
    shut = ~special | (F.col("kind").isin("road", "tram_tracks") & ~F.col("steep"))
    reach = F.coalesce(F.element_at(F.create_map(*[x for k, v in catalog.EXTENSION.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(2))
    extra = (catalog.crossing_factor(F.col("kind")).cast("double") - 1) * 2 * reach
    met = hit.groupBy("way").agg(F.max(shut).alias("shut"), F.sum(F.when(special, extra)).alias("extra"))
    price = catalog.of_pipe(F.col("dn"), "new_price", "decimal(12,2)").cast("double")
    cost = price * (F.col("length") + F.least(F.col("length"), F.coalesce("extra", F.lit(0.0))))
    return ways.join(met, "way", "left").where("not coalesce(shut, false)").withColumn("cost", F.round(cost, 2)).drop("way", "shut", "extra")


def _nearest(points: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """Each point with its `most` nearest roots of its scene, by rings of cells of double radius."""
    found, left, r = None, points, float(CELL)
    span = roots.agg(F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")).first()
    own = points.agg(F.max("x"), F.min("x"), F.max("y"), F.min("y")).first()
    ends = roots.agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    whole = 0.0 if span[0] is None or own[0] is None else max(abs(a - b) for a in own for b in ends)
    d = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    while True:
        at = tuple(F.col(c) + s * r for c, s in (("x", -1), ("y", -1), ("x", 1), ("y", 1)))
        spot = tuple(F.col(c) for c in ("rx", "ry", "rx", "ry"))
        near = spatial.near(left, roots, at, spot, max(1, int(r)), ["scene_id"]).withColumn("_d", d)
        ranked = cut(network.best_of(near, ["point"], ["_d", "root"], most))
        last = r >= whole
        full = ranked.where((F.col("rank") == most) & (F.col("_d") <= r)).select("point")
        done = (ranked if last else ranked.join(full, "point", "left_semi")).drop("_d", "rank")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = cut(left.join(full, "point", "left_anti"))
        if left.isEmpty():
            return found
        r *= 2


def assign(ways: DataFrame, by: list[str]) -> DataFrame:
    """One way for each demand so that no root gets more rays than it can take: rows of `by`, demand, root, free and
    cost. Demands ask their cheapest root, a root keeps the cheapest that fit and sends the others on, round after
    round; nobody would change for a root that would take them. A demand that all refuse stays without."""
    order = Window.partitionBy(*by, "demand").orderBy("cost", "root")
    asks = cut(ways.withColumn("_turn", F.row_number().over(order)))
    at = cut(asks.select(*by, "demand").distinct().withColumn("_turn", F.lit(1)))
    while True:
        now = asks.join(at, [*by, "demand", "_turn"])
        place = F.row_number().over(Window.partitionBy(*by, "root").orderBy("cost", "demand"))
        now = cut(now.withColumn("_kept", place <= F.col("free")))
        sent = now.where("not _kept").select(*by, "demand", F.lit(1).alias("_sent"))
        if sent.isEmpty():
            return now.drop("_turn", "_kept")
        at = cut(at.join(sent, [*by, "demand"], "left").select(*by, "demand", (F.col("_turn") + F.coalesce("_sent", F.lit(0))).cast("int").alias("_turn")))


def portfolio(ways: DataFrame, restarts: int, seed: int = 1, spread: float = 0.1) -> DataFrame:
    """The ways of each restart, a row for each (scene, restart): the first keeps the costs, the others ask as if
    costs were up to `spread` higher, by a stream of their own; `paid` is the true cost."""
    k = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")
    rows = ways.select("*", k).withColumn("paid", F.col("cost"))
    noise = F.when(F.col("restart") == 0, 0.0).otherwise(spread * stream(seed, F.col("restart"), F.col("demand"), F.col("root")))
    return rows.withColumn("cost", F.col("cost") * (1 + noise))


def variants(ways: DataFrame, demands: DataFrame, restarts: int = 4, most: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The best `most` different layouts of each scene: (chosen ways, ranked variants).

    Every restart is assigned at once; a layout is known by which demand goes to which root, equal ones are one;
    layouts that connect the most demands stay, in order of their score.
    """
    chosen = cut(assign(portfolio(ways, restarts, seed), ["scene_id", "restart"]))
    runs = demands.select("scene_id").distinct().withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    mark = F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "demand", "root"))), ";")
    made = chosen.groupBy("scene_id", "restart").agg(F.sum("paid").cast("decimal(18,2)").alias("pipes"), F.sum("length").cast("decimal(18,9)").alias("length"), F.count_distinct("root").alias("ties"), F.sha2(mark, 256).alias("signature"))
    every = demands.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    lost = every.join(chosen.select("scene_id", "restart", "demand"), ["scene_id", "restart", "demand"], "left_anti")
    lost = lost.groupBy("scene_id", "restart").agg(F.count("*").alias("missing"), F.sum(pricing.penalty(F.col("flow"))).alias("penalty"))
    rows = runs.join(made, ["scene_id", "restart"], "left").join(lost, ["scene_id", "restart"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cost = (zero("pipes") + zero("ties") * catalog.TIE_IN_PRICE + zero("penalty")).cast("decimal(18,2)")
    rows = rows.select("scene_id", "restart", zero("missing").alias("missing"), cost.alias("cost"), zero("length").cast("decimal(18,9)").alias("length"), F.coalesce("signature", F.lit("")).alias("signature"))
    rows = rows.withColumn("score", pricing.score(F.col("cost"), F.col("length")))
    first = Window.partitionBy("scene_id", "signature").orderBy("score", "restart")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    least = F.min("missing").over(Window.partitionBy("scene_id"))
    ranked = cut(network.best_of(rows.withColumn("_least", least).where("missing = _least").drop("_least"), ["scene_id"], ["score", "restart"], most))
    return chosen.join(ranked.select("scene_id", "restart", "rank"), ["scene_id", "restart"]), ranked


def greedy_cover(options: DataFrame) -> DataFrame:
    """scene_id, option and turn of the options taken when each turn takes the cheapest per demand not yet covered.
    options has scene_id, option, cost and demands (an array)."""
    left, taken, turn = cut(options), None, 0
    while True:
        turn += 1
        some = left.where(F.size("demands") > 0)
        pick = network.best_of(some, ["scene_id"], [F.col("cost") / F.size("demands"), "option"], 1).select("scene_id", "option", F.col("demands").alias("_gone"))
        pick = cut(pick)
        if pick.isEmpty():
            return taken.select("scene_id", "option", "turn") if taken is not None else options.select("scene_id", "option", F.lit(0).alias("turn")).where("false")
        new = pick.withColumn("turn", F.lit(turn))
        taken = new if taken is None else taken.union(new)
        rest = left.join(pick.drop("option"), "scene_id").withColumn("demands", F.array_except("demands", "_gone")).drop("_gone")
        left = cut(rest)


def exact_cover(options: DataFrame, demands: DataFrame) -> DataFrame:
    """The cheapest set of options that covers each demand of a scene exactly once, if there is one: scene_id, cost
    and chosen. options has scene_id, option, cost and demands (an array); demands has scene_id and demand.

    Partial covers of all scenes grow side by side, each by the options that hold its first open demand. Of partial
    covers with the same demands only the cheapest stays, and those that cost more than the best whole cover, with
    what the open demands cost at least, go: nothing that could be best is dropped.
    """
    share = options.select("scene_id", F.explode("demands").alias("demand"), (F.col("cost") / F.size("demands")).alias("share"))
    least = share.groupBy("scene_id", "demand").agg(F.min("share").alias("share"))
    all_ = demands.join(least, ["scene_id", "demand"], "left").groupBy("scene_id").agg(F.array_sort(F.collect_set("demand")).alias("open"), F.map_from_entries(F.collect_list(F.struct("demand", F.coalesce("share", F.lit(float("inf")))))).alias("least"))
    state = cut(all_.select("scene_id", "open", F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("chosen"), "least"))
    by_demand = cut(options.select("scene_id", F.col("option").cast("string").alias("option"), F.col("cost").alias("_cost"), F.array_sort("demands").alias("demands"), F.explode("demands").alias("_first")))
    best = None
    while not state.isEmpty():
        grown = state.withColumn("_first", F.get("open", 0)).join(by_demand, ["scene_id", "_first"]).where(F.size(F.array_except("demands", "open")) == 0)
        grown = grown.select("scene_id", F.array_except("open", "demands").alias("open"), (F.col("cost") + F.col("_cost")).alias("cost"), F.array_append("chosen", F.col("option")).alias("chosen"), "least")
        one = Window.partitionBy("scene_id", "open").orderBy("cost", "chosen")
        grown = cut(grown.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"))
        whole = grown.where(F.size("open") == 0).select("scene_id", "cost", "chosen")
        best = whole if best is None else best.union(whole)
        best = cut(best.groupBy("scene_id").agg(F.min(F.struct("cost", "chosen")).alias("b")).select("scene_id", "b.*"))
        bound = F.aggregate("open", F.lit(0.0), lambda a, d: a + F.coalesce(F.element_at("least", d), F.lit(float("inf"))))
        state = grown.where(F.size("open") > 0).join(best.select("scene_id", F.col("cost").alias("_best")), "scene_id", "left")
        state = cut(state.where(F.col("_best").isNull() | (F.col("cost") + bound < F.col("_best"))).drop("_best"))
    return best if best is not None else all_.select("scene_id", F.lit(0.0).alias("cost"), F.lit(None).cast("array<string>").alias("chosen")).where("false")


def fields(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """scene_id, x, y and cost of the cheapest way from a seed to each cell that can be reached: cells has scene_id,
    integer x, y and price (of a unit of way in it), seeds scene_id, x, y. A step goes to one of eight neighbours
    and costs its length times the mean price. Rounds go on from the cells that became cheaper, over all scenes."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit((dx * dx + dy * dy) ** 0.5).alias("way")) for dx, dy in steps]))
    cells = cut(cells.select("scene_id", "x", "y", F.col("price").cast("double").alias("price")))
    best = cut(seeds.join(cells, ["scene_id", "x", "y"]).select("scene_id", "x", "y", "price", F.lit(0.0).alias("cost")).distinct())
    front = best
    while True:
        out = front.select("scene_id", "x", "y", F.col("price").alias("_p"), F.col("cost").alias("_c"), moves.alias("m"))
        out = out.select("scene_id", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "_p", "_c", F.col("m.way").alias("way"))
        new = out.join(cells, ["scene_id", "x", "y"]).withColumn("cost", F.col("_c") + F.col("way") * (F.col("_p") + F.col("price")) / 2)
        new = new.groupBy("scene_id", "x", "y").agg(F.first("price").alias("price"), F.min("cost").alias("cost"))
        known = best.select("scene_id", "x", "y", F.col("cost").alias("_known"))
        front = cut(new.join(known, ["scene_id", "x", "y"], "left").where(F.col("_known").isNull() | (F.col("cost") < F.col("_known") - 1e-12)).drop("_known"))
        if front.isEmpty():
            return best.drop("price")
        both = best.union(front.select("scene_id", "x", "y", "price", "cost"))
        best = cut(both.groupBy("scene_id", "x", "y").agg(F.first("price").alias("price"), F.min("cost").alias("cost")))
