"""Shapes of single lines that need their corners one after the other."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from calorgrid.functions import geometry
from calorgrid.operators.lineage import cut

SAME, OFF, TURN = 1e-7, 1e-6, 0.01  # m, m, degrees


def _off(p, a, b) -> float:
    """The distance of p from segment a-b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _turn(a, b, c) -> float:
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    return math.degrees(abs(math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))


def simplify(corners: DataFrame, key: str = "line") -> DataFrame:
    """key, seq, x, y of the corners that stay. What a corner is held against depends on which stayed before it, so
    a line's corners are taken in order, by one task per line: a line is one shape, never a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            p = (r.x, r.y)
            if kept and math.dist(kept[-1][1], p) < SAME:
                continue
            while len(kept) > 1 and _off(kept[-1][1], kept[-2][1], p) <= OFF and _turn(kept[-2][1], kept[-1][1], p) < TURN:
                kept.pop()
            kept.append((r.seq, p))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(kept), "seq": [s for s, _ in kept], "x": [p[0] for _, p in kept], "y": [p[1] for _, p in kept]})

    rows = corners.select(key, "seq", "x", "y")
    return rows.groupBy(key).applyInPandas(run, rows.schema)


def thin(corners: DataFrame, tolerance: float, key: str = "line") -> DataFrame:
    """key, seq, x, y of the corners that are left when those within `tolerance` of what is left go (Douglas and
    Peucker): a stretch keeps its farthest corner, the first of equals, if that is farther, and splits there.

    All stretches of all lines split at once, one grouped maximum and one join a round over the corners of stretches
    that still split; a line of n corners takes about log2(n) rounds, n at worst.
    """
    at = F.struct("seq", "x", "y")
    ends = cut(corners.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi")))
    open_ = cut(corners.select(key, "seq", "x", "y").join(ends, key).where("seq > lo.seq and seq < hi.seq"))
    kept = ends.select(key, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select(key, "p.*")
    away = geometry.distance2(F.col("x"), F.col("y"), *(F.col(c) for c in ("lo.x", "lo.y", "hi.x", "hi.y")))
    while True:
        best = F.max(F.struct(away.alias("d2"), (-F.col("seq")).alias("first"), at.alias("p")))
        far = open_.groupBy(key, F.col("lo.seq").alias("_lo")).agg(best.alias("m"))
        far = cut(far.where(F.col("m.d2") > tolerance * tolerance).select(key, "_lo", F.col("m.p").alias("p")))
        if far.isEmpty():
            return kept
        kept = kept.union(far.select(key, "p.*"))
        met = open_.withColumn("_lo", F.col("lo.seq")).join(far, [key, "_lo"]).where("seq <> p.seq")
        before = F.col("seq") < F.col("p.seq")
        halves = met.select(key, "seq", "x", "y", F.when(before, F.col("lo")).otherwise(F.col("p")).alias("lo"), F.when(before, F.col("p")).otherwise(F.col("hi")).alias("hi"))
        open_ = cut(halves, open_)
