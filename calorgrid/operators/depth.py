"""Depths along lines: envelopes of what crossings ask for, by sweeps of their stations in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.operators import intervals, tree
from calorgrid.operators.lineage import cut

NORMAL, COVER, SLOPE, SPLIT = 3.0, 0.7, 0.1, 3.0  # m, m, m a metre, the depth from which digging costs more


def _sweep(probes: DataFrame, balls: DataFrame, value: str, how: str, slope, key: str) -> DataFrame:
    """key, s and best: the strictest `value` of any ball at each probe, weakened by the slope times the way from
    the ball's edge. From the left a ball counts from its right edge on as value -/+ slope * way, which is the value
    at station 0 and a line that all balls share; so a running best is enough. The same from the right, and inside
    a ball its own value holds, by bins of stations."""
    sign = 1 if how == "max" else -1
    balls = balls.where(F.col(value).isNotNull())
    found = []
    for turn in (1, -1):
        at = (F.col("s") + turn * F.col("r")) * turn
        marks = balls.select(key, at.alias("_at"), F.lit(0).alias("_kind"), (F.col(value) + sign * slope * at).alias("_v"), F.col("s").alias("_s"))
        asks = probes.select(key, (F.col("s") * turn).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_v"), F.col("s").alias("_s"))
        rows = intervals.running(marks.union(asks), [key], ["_at", "_kind"], "_v", how, "_best")
        found.append(rows.where("_kind = 1").select(key, F.col("_s").alias("s"), (F.col("_best") - sign * slope * F.col("_at")).alias("best")))
    span = balls.select(key, (F.col("s") - F.col("r")).alias("a"), (F.col("s") + F.col("r")).alias("b"), value)
    bins = lambda c: F.floor(c / intervals.BIN).cast("long")
    covers = span.withColumn("_bin", F.explode(F.sequence(bins(F.col("a")), bins(F.col("b")))))
    inside = probes.withColumn("_bin", bins(F.col("s"))).join(covers, [key, "_bin"]).where("s between a and b")
    found.append(inside.select(key, "s", F.col(value).alias("best")))
    return found[0].union(found[1]).union(found[2]).groupBy(key, "s").agg(getattr(F, how)("best").alias("best"))


def envelope(probes: DataFrame, balls: DataFrame, normal=NORMAL, cover=COVER, slope=SLOPE, key: str = "line") -> DataFrame:
    """lower, upper, depth and infeasible at each probe (key, s). balls has key, s, r (its radius along the line),
    low (no shallower than) and high (no deeper than), either null; a line without balls keeps the normal depth."""
    low = _sweep(probes, balls, "low", "max", slope, key).withColumnRenamed("best", "lower")
    high = _sweep(probes, balls, "high", "min", slope, key).withColumnRenamed("best", "upper")
    kind = dict(balls.dtypes)["low"]
    both = probes.join(low, [key, "s"], "left").join(high, [key, "s"], "left")
    both = both.withColumn("lower", F.greatest(F.lit(cover).cast(kind), "lower"))
    depth = F.least(F.greatest(F.lit(normal).cast(kind), "lower"), "upper")
    return both.select(key, "s", "lower", "upper", depth.alias("depth"), F.coalesce(F.col("lower") > F.col("upper"), F.lit(False)).alias("infeasible"))


def _reached(links: DataFrame, asks: DataFrame) -> DataFrame:
    """edge, a, b, length, kind and value: the stretches of edges that asks (edge, s, r, kind, value) cover, at most r
    from their station on all ways. An ask that reaches an end of its edge goes on from there with what is left of
    its radius; of those of one value that leave an edge by one end the farthest reaching does for all."""
    own = asks.join(links.where("up").select("edge", "length", "far", F.col("node").alias("_low")), "edge")
    a, b = F.greatest(F.col("s") - F.col("r"), F.lit(0)), F.least(F.col("s") + F.col("r"), F.col("length"))
    found = [cut(own.select("edge", a.alias("a"), b.alias("b"), "length", "kind", "value"))]
    on = F.array(F.struct(F.col("far").alias("node"), (F.col("r") - F.col("s")).alias("left")), F.struct(F.col("_low").alias("node"), (F.col("r") - F.col("length") + F.col("s")).alias("left")))
    front = own.select(F.col("edge").alias("via"), "kind", "value", F.explode(on).alias("_on")).select("via", "kind", "value", "_on.*")
    while True:
        front = cut(front.where("left > 0").groupBy("node", "via", "kind", "value").agg(F.max("left").alias("left")))
        if front.isEmpty():
            break
        met = front.join(links, "node").where("edge <> via")
        into = F.least("left", "length")
        a, b = F.when(F.col("up"), F.col("length") - into).otherwise(F.lit(0)), F.when(F.col("up"), F.col("length")).otherwise(into)
        found.append(cut(met.select("edge", a.alias("a"), b.alias("b"), "length", "kind", "value")))
        front = met.select(F.col("edge").alias("via"), "kind", "value", F.col("far").alias("node"), (F.col("left") - F.col("length")).alias("left"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def tree_envelope(nodes: DataFrame, balls: DataFrame, probes: DataFrame, normal=NORMAL, cover=COVER, slope=SLOPE) -> DataFrame:
    """`envelope` where the way from a ball to a probe leads through a tree: edge, s, lower, upper, depth, infeasible.

    nodes has node, parent (null at roots) and length, that of the edge from its parent, which bears the node's name
    (a root's counts as 0); balls (edge, s, r, low, high) and probes (edge, s) lie s from the edge's upper end. Probes on edges that no root
    reaches, or that are none, are left out; without balls the normal depth holds.

    No pair of a ball and a probe is formed. Balls become the stretches that they cover, stretches what they ask at
    the ends of their edges. The strictest of what hangs on a node, less the slope times the way up, is one climb, as
    value - slope * way from the root; the strictest of all ancestors, less the way down, is another: an ancestor's
    value that came from the node's own branch has gone a longer way than need be, and so is never too strict. Then
    each edge is a line with its stretches and its two ends. Rounds are a logarithm of the tree's depth, and the number
    of edges that the widest ball passes; rows are the edges that balls touch.
    """
    nodes = nodes.select("node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(F.col("length")).alias("len"))
    way = tree.climb(nodes.withColumn("way", F.col("len")), along={"way": "sum"}).select("node", "parent", "way")
    edges = cut(way.join(nodes.select("node", "len"), "node"))
    real = edges.where("parent is not null")
    links = real.select(F.col("node"), F.col("node").alias("edge"), F.col("parent").alias("far"), F.col("len").alias("length"), F.lit(True).alias("up"))
    links = cut(links.union(real.select("parent", "node", "node", "len", F.lit(False))))
    # what is asked as a maximum: lower bounds as they are, upper bounds with the other sign
    kinds = F.array(F.struct(F.lit("low").alias("kind"), F.col("low").alias("value")), F.struct(F.lit("high").alias("kind"), (-F.col("high")).alias("value")))
    asks = balls.select("edge", "s", "r", F.explode(kinds).alias("_k")).select("edge", "s", "r", "_k.*").where("value is not null")
    reached = cut(_reached(links, asks))
    ends = F.array(F.struct(F.lit(True).alias("up"), F.col("a").alias("off")), F.struct(F.lit(False).alias("up"), (F.col("length") - F.col("b")).alias("off")))
    at = reached.select("edge", "kind", "value", F.explode(ends).alias("_e")).join(real.select(F.col("node").alias("edge"), "parent"), "edge")
    at = at.select(F.when(F.col("_e.up"), F.col("parent")).otherwise(F.col("edge")).alias("node"), "kind", (F.col("value") - slope * F.col("_e.off")).alias("value"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
    own = edges.join(at.groupBy("node").agg(pick("low"), pick("high")), "node", "left")
    up = tree.climb(own.select("node", "parent", "way", *[(F.col(c) - slope * F.col("way")).alias(c) for c in ("low", "high")]), below={"low": "max", "high": "max"})
    down = tree.climb(up.join(edges.select("node", "way"), "node").select("node", "parent", *[(F.col(c) + 2 * slope * F.col("way")).alias(c) for c in ("low", "high")]), along={"low": "max", "high": "max"})
    best = cut(down.join(edges.select("node", "way", "len"), "node").select("node", "parent", "len", *[(F.col(c) - slope * F.col("way")).alias(c) for c in ("low", "high")]))
    lower_end = best.where("parent is not null").select(F.col("node").alias("edge"), F.col("len").alias("a"), F.col("len").alias("b"), "low", "high")
    upper_end = real.select(F.col("node").alias("edge"), F.col("parent").alias("node")).join(best.drop("parent"), "node").select("edge", F.lit(0).alias("a"), F.lit(0).alias("b"), "low", "high")
    inside = reached.select("edge", "a", "b", *[F.when(F.col("kind") == c, F.col("value")).alias(c) for c in ("low", "high")])
    all_ = inside.union(lower_end).union(upper_end)
    lines = all_.select("edge", ((F.col("a") + F.col("b")) / 2).cast("double").alias("s"), ((F.col("b") - F.col("a")) / 2).cast("double").alias("r"), F.col("low").cast("double").alias("low"), (-F.col("high")).cast("double").alias("high"))
    asked = probes.join(real.select(F.col("node").alias("edge")), "edge", "left_semi").withColumn("s", F.col("s").cast("double"))
    return envelope(asked, cut(lines), normal, cover, slope, "edge")


def ramp_cost(length: Column, price: Column, start: Column, end: Column) -> Column:
    """The price of a ramp: its coefficient grows by a tenth a metre below SPLIT, where a ramp through that depth is
    cut in two; null where it is too shallow or too steep."""
    coefficient = lambda h: 1 + 0.1 * F.greatest(F.lit(0.0), h - SPLIT)
    share = (SPLIT - start) / F.nullif(end - start, F.lit(0.0))
    cut = length * share * (coefficient(start) + 1) / 2 + length * (1 - share) * (1 + coefficient(end)) / 2
    whole = length * (coefficient(start) + coefficient(end)) / 2
    valid = (length > 0) & (F.least(start, end) >= COVER) & (F.abs(end - start) <= SLOPE * length + 1e-9)
    return F.when(valid, F.round(F.when((start - SPLIT) * (end - SPLIT) < 0, cut).otherwise(whole).cast("decimal(28,9)") * price.cast("decimal(12,2)"), 2))


def bounds(sine: Column, width: Column, depth: Column, height: Column, under_only: Column, gap=0.2, cover=COVER, reach=1.0):
    """What a crossing asks for: the half length of line that it concerns (longer for flat angles), the depth from
    which the pipe passes below it, and the depth up to which it passes above (null under a road, or if that would
    be too shallow)."""
    radius = (width / 2 + reach) / F.nullif(sine, F.lit(0.0))
    above = F.when(~under_only & (depth - gap - height >= cover), depth - gap - height)
    return radius, depth + gap, above


def split(profile: DataFrame, key: str = "line") -> DataFrame:
    """The break points of profiles (key, s, h) with those where a ramp passes SPLIT added and those that lie
    straight between their neighbours left out; windows run over bins of stations."""
    nexts = intervals.following(profile.select(key, F.col("s").alias("a")), [key])
    step = profile.join(nexts.select(key, F.col("a").alias("s"), F.col("b").alias("s2")), [key, "s"])
    after = profile.select(key, F.col("s").alias("s2"), F.col("h").alias("h2"))
    ramps = step.join(after, [key, "s2"])
    at = F.col("s") + (SPLIT - F.col("h")) * (F.col("s2") - F.col("s")) / (F.col("h2") - F.col("h"))
    through = ramps.where((F.col("h") - SPLIT) * (F.col("h2") - SPLIT) < 0).select(key, at.alias("s"), F.lit(SPLIT).alias("h"))
    before = ramps.select(key, F.col("s2").alias("s"), F.col("s").alias("s0"), F.col("h").alias("h0"))
    joined = ramps.join(before, [key, "s"], "left")
    bent = F.abs((F.col("h") - F.col("h0")) * (F.col("s2") - F.col("s")) - (F.col("h2") - F.col("h")) * (F.col("s") - F.col("s0"))) > 1e-9
    kept = joined.where(F.col("s0").isNull() | bent | (F.col("h") == SPLIT)).select(key, "s", "h")
    last = profile.join(ramps.select(key, "s"), [key, "s"], "left_anti").select(key, "s", "h")
    return kept.union(last).union(through)
