"""Stretches [a, b) of a line with a factor: overlays, unions, sums and cuts, by sweeps of their ends.

A line may be long and busy, so nothing is done per line in one task: stations fall into bins, windows run within
a bin, and what a bin hands on to the next is carried by a second window over one row per bin. The bins of sweeps are
wide, as most lines then have one and nothing to carry; those in which stretches meet others are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = 64  # stations
WIDE = 1 << 14  # stations of a bin of a sweep


def _bin(at: Column) -> Column:
    return F.floor(at / BIN).cast("long")


def sweep(rows: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, str]] | None = None, nexts: dict[str, str] | None = None, before: bool = False) -> DataFrame:
    """Add, in the order of the columns `order`, of which the first is the station: `totals`, running values by name, each
    of a column and its sum, max or min, with `before` over the rows before this one, null where there is none; and
    `nexts`, columns of the row at the next station by name, null after the last, for which stations have one row each.

    Rows are shuffled once, for the windows within bins and what the bins hand on alike; of that, only rows that say
    something are joined back.
    """
    totals, nexts = totals or {}, nexts or {}
    rows = rows.withColumn("_bin", F.floor(F.col(order[0]) / WIDE).cast("long")).repartition(*key, "_bin")
    within, bins_of = Window.partitionBy(*key, "_bin").orderBy(*order), Window.partitionBy(*key).orderBy("_bin")
    to, earlier = (w.rowsBetween(Window.unboundedPreceding, end) for w, end in ((within, -1 if before else 0), (bins_of, -1)))
    # a station alone is grouped by hashes, a row with more to tell by a sort
    row = F.struct(F.col(order[0]).alias("_at"), *[F.col(c).alias(out) for out, c in nexts.items()]) if set(nexts.values()) - {order[0]} else F.col(order[0])
    of = {out: getattr(F, how) for out, (_, how) in totals.items()}
    own = {f"_own_{out}": of[out](value).over(to) for out, (value, _) in totals.items()}
    bins = rows.groupBy(*key, "_bin").agg(*[of[out](value).alias(f"_of_{out}") for out, (value, _) in totals.items()], *([F.min(row).alias("_first")] if nexts else []))
    carry = {f"_carry_{out}": f(f"_of_{out}").over(earlier) for out, f in of.items()}
    if nexts:
        own["_own_next"], carry["_carry_next"] = F.lead(row).over(within), F.lead("_first").over(bins_of)
    bins = bins.select(*key, "_bin", *[c.alias(name) for name, c in carry.items()])
    bins = bins.where(" or ".join(f"{name} is not null" for name in carry))
    joined = rows.withColumns(own).join(bins, [*key, "_bin"], "left")

    def both(out: str, how: str) -> Column:
        a, b = F.col(f"_own_{out}"), F.col(f"_carry_{out}")
        return F.coalesce(a + b, a, b) if how == "sum" else {"max": F.greatest, "min": F.least}[how](a, b)

    found = {out: both(out, how) for out, (_, how) in totals.items()}
    after = F.coalesce("_own_next", "_carry_next")
    found |= {out: after[out] if set(nexts.values()) - {order[0]} else after for out in nexts}
    return joined.withColumns(found).drop(*own, *carry, "_bin")


def running(rows: DataFrame, key: list[str], order: list[str], value: str, how: str, out: str, before: bool = False) -> DataFrame:
    """Add `out`: the running sum, max or min of `value` in the order of the columns `order`, of which the first is the
    station; with `before` over the rows before this one. Null where there is none."""
    return sweep(rows, key, order, {out: (value, how)}, before=before)


def following(ends: DataFrame, key: list[str], at: str = "a", out: str = "b") -> DataFrame:
    """Add `out`, the next station of the key after `at`; null after the last. `ends` has one row per station."""
    return sweep(ends, key, [at], nexts={out: at})


def elementary(zones: DataFrame, key: str = "line") -> DataFrame:
    """key, a, b: the stretches between successive ends."""
    ends = zones.select(key, F.explode(F.array("a", "b")).alias("a")).distinct()
    return following(ends, [key]).where("b is not null")


def islands(zones: DataFrame, by: list[str]) -> DataFrame:
    """Stretches that touch or overlap become one: by, a, b and n, the number joined."""
    # equal stretches are one row, as the two sums below have to take rows in the same order
    one = zones.groupBy(*by, "a", "b").agg(F.count("*").alias("_same"))
    rows = running(one, by, ["a", "b"], "b", "max", "_top", before=True)
    rows = rows.withColumn("_new", F.coalesce((F.col("a") > F.col("_top")).cast("long"), F.lit(1)))
    rows = running(rows, by, ["a", "b"], "_new", "sum", "_group")
    return rows.groupBy(*by, "_group").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("_same").alias("n")).drop("_group")


def _pieces(stretches: DataFrame, key: str) -> DataFrame:
    """Each stretch as _a, _b in the bins that it meets."""
    bins = F.sequence(_bin(F.col("a")), _bin(F.col("b")))
    rest = [c for c in stretches.columns if c not in (key, "a", "b")]
    return stretches.select(F.col(key).alias("_key"), F.explode(bins).alias("_bin"), F.col("a").alias("_a"), F.col("b").alias("_b"), *rest)


def _factors(zones: DataFrame, key: str) -> DataFrame:
    """The zones of each factor as islands: there are few factors, so a station lies in few of them."""
    return _pieces(islands(zones, [key, "k"]).drop("n"), key)


def _overlay(parts: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """parts (key, a, b, which no zone's end divides) with k, the largest factor over them; null if none."""
    z = _factors(zones, key)
    at = parts.withColumn("_at", _bin(F.col("a")))
    over = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & (F.col("_a") <= F.col("a")) & (F.col("_b") >= F.col("b"))
    return at.join(z, over, "left").groupBy(*parts.columns).agg(F.max("k").alias("k"))


def piecewise_max(zones: DataFrame, key: str = "line") -> DataFrame:
    """The largest factor k over each elementary stretch that has one; stretches aren't merged."""
    return _overlay(elementary(zones, key), zones, key).where("k > 1")


def interval_sum(zones: DataFrame, value: str, key: str = "line") -> DataFrame:
    """The sum of a value over each elementary stretch that a zone covers: a zone adds it at its start and takes it
    back at its end, and running sums say what holds."""
    step = lambda at, sign: F.struct(F.col(at).alias("a"), (F.col(value) * sign).alias("v"), F.lit(sign).alias("n"))
    steps = zones.select(key, F.explode(F.array(step("a", 1), step("b", -1))).alias("s")).select(key, "s.*")
    steps = steps.groupBy(key, "a").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = sweep(steps, [key], ["a"], {"total": ("v", "sum"), "_open": ("n", "sum")}, {"b": "a"})
    return rows.where("_open > 0 and b is not null").select(key, "a", "b", "total")


def union_max(zones: DataFrame, key: str = "line") -> DataFrame:
    """Zones that touch or overlap become one, with the largest factor, the number that it joins, and the factors
    among them in order (one of the catalogue's few each)."""
    found = islands(zones, [key])
    z = _pieces(found.select(key, "a", "b"), key)
    at = zones.select(key, F.col("a").alias("_s"), "k").withColumn("_at", _bin(F.col("_s")))
    of = at.join(z, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & F.col("_s").between(F.col("_a"), F.col("_b")))
    best = of.groupBy(key, F.col("_a").alias("a")).agg(F.max("k").alias("k"), F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), "+").alias("sources"))
    return found.join(best, [key, "a"]).select(key, "a", "b", "k", "n", "sources")


def factor_at(zones: DataFrame, probes: DataFrame, key: str = "line") -> DataFrame:
    """key, s and the largest factor of the zones that hold station s (ends included), 1 if none does."""
    at = probes.withColumn("_at", _bin(F.col("s")))
    hold = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & F.col("s").between(F.col("_a"), F.col("_b"))
    hit = at.join(_factors(zones, key), hold, "left")
    return hit.groupBy(key, "s").agg(F.coalesce(F.max("k"), F.lit(1).cast("decimal(4,2)")).alias("k"))


def cut(lines: DataFrame, zones: DataFrame, key: str = "line") -> DataFrame:
    """Cut lines (key, length) at the ends of their zones: key, piece, a, b, k (the largest over the piece)."""
    inner = zones.select(key, F.explode(F.array("a", "b")).alias("a")).join(lines, key).where("a <= length").select(key, "a")
    ends = lines.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("length"))).alias("a"))
    pieces = following(ends.union(inner).distinct(), [key]).where("b is not null").withColumn("_one", F.lit(1).cast("long"))
    pieces = running(pieces, [key], ["a"], "_one", "sum", "piece").select(key, (F.col("piece") - 1).cast("int").alias("piece"), "a", "b")
    return _overlay(pieces, zones, key).withColumn("k", F.coalesce("k", F.lit(1).cast("decimal(4,2)")))
