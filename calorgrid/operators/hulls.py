"""Hulls of points, and the least rectangles around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BLOCK = 1024  # columns of unit width whose points one task takes at first


def _bend(points: list[tuple[int, int]], sign: int) -> list[tuple[int, int]]:
    """Of points in order of x those where the lower (sign 1) or upper (-1) border bends."""
    kept: list[tuple[int, int]] = []
    for x, y in points:
        while len(kept) > 1:
            (x0, y0), (x1, y1) = kept[-2:]
            if sign * ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) > 0:
                break
            kept.pop()
        kept.append((x, y))
    return kept


def _borders(x: list[int], low: list[int], high: list[int]) -> tuple[list, list]:
    """The lower and the upper border of columns in order of x; equal x follow each other."""
    lows, highs = {}, {}
    for i, j, k in zip(x, low, high):
        lows[i], highs[i] = min(lows.get(i, j), j), max(highs.get(i, k), k)
    return _bend(list(lows.items()), 1), _bend(list(highs.items()), -1)


def _shapes(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """The groups of rows in order of `by`, x that each batch ends: the type of the first of `by`, and per group its
    value and lists of x, low and high."""
    kind, name, held = None, None, ([], [], [])
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(by[0]).type
        codes = [np.asarray(pc.dictionary_encode(batch.column(c), null_encoding="encode").indices) for c in by]
        heads = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()]
        names = list(zip(*(batch.column(c).take(pa.array(heads)).to_pylist() for c in by)))
        values = [batch.column(c).to_pylist() for c in ("x", "low", "high")]
        done = []
        for key, start, end in zip(names, heads, [*heads[1:], batch.num_rows]):
            if held[0] and key != name:
                done.append((name[0], *held))
                held = ([], [], [])
            name = key
            for h, v in zip(held, values):
                h += v[start:end]
        yield kind, done
    if held[0]:
        yield kind, [(name[0], *held)]


def _spans(hull: list[tuple[int, int]]) -> list[tuple]:
    """Per side of a hull against the clock: its ends and the extent of the hull along and across it, times the
    side's length. Projections rise and fall once around a hull, so the corners where they turn only move on."""
    n = len(hull)
    out, far = [], [1, 1, 1]
    for i in range(n):
        (px, py), (qx, qy) = hull[i], hull[(i + 1) % n]
        dx, dy = qx - px, qy - py
        # along the side, across it, and back along it: each corner is sought from the one before
        at = [lambda x, y: (x - px) * dx + (y - py) * dy, lambda x, y: (y - py) * dx - (x - px) * dy, lambda x, y: (px - x) * dx + (py - y) * dy]
        for k, f in enumerate(at):
            far[k] = max(far[k], i + 1, far[k - 1] if k else 0)
            while far[k] < i + n and f(*hull[(far[k] + 1) % n]) >= f(*hull[far[k] % n]):
                far[k] += 1
        ends = [f(*hull[m % n]) for f, m in zip(at, far)]
        out.append((px, py, qx, qy, ends[0] + ends[2], ends[1]))
    return out


def sides(points: DataFrame, key: str = "line") -> DataFrame:
    """The sides of the hull of each key's points (key and integers x, y): px, py, qx, qy against the clock, with the
    extent of the hull along and across the side, both times its length. A hull of two points has two sides, one of a
    single point a side without length; points on a side are no corners; rows with nulls are no points.

    Only the lowest and the highest point of a column can be corners, which a grouped minimum keeps before anything
    is shuffled; blocks of columns then give partial hulls, and a hull is formed of those, so that no task takes more
    than a block's columns or the corners of a shape's partial hulls.
    """
    kind = dict(points.dtypes)[key]
    columns = points.where("x is not null and y is not null").groupBy(key, F.col("x").cast("long").alias("x")).agg(F.min("y").cast("long").alias("low"), F.max("y").cast("long").alias("high"))
    parts_of, sides_of = ["x", "low", "high"], ["px", "py", "qx", "qy", "along", "across"]

    def table(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        of = zip(*rows) if rows else [()] * (len(names) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(of, [kind] + [pa.int64()] * len(names))], names=[key, *names])

    # groups follow each other in a stream, as there may be very many small ones
    def partial(batches):
        for kind, done in _shapes(batches, [key, "_block"]):
            yield table([(name, x, y, y) for name, *columns in done for border in _borders(*columns) for x, y in border], kind, parts_of)

    def whole(batches):
        for kind, done in _shapes(batches, [key]):
            rows = []
            for name, *columns in done:
                low, high = _borders(*columns)
                hull = low + [p for p in high[::-1] if p != low[-1] and p != low[0]]
                rows += [(name, *r) for r in (_spans(hull) if len(hull) > 1 else [(*hull[0], *hull[0], 0, 0)])]
            yield table(rows, kind, sides_of)

    longs = lambda names: ", ".join([f"`{key}` {kind}", *(f"{c} long" for c in names)])
    blocks = columns.withColumn("_block", F.floor(F.col("x") / BLOCK)).repartition(key, "_block").sortWithinPartitions(key, "_block", "x")
    parts = blocks.mapInArrow(partial, longs(parts_of))
    return parts.repartition(key).sortWithinPartitions(key, "x").mapInArrow(whole, longs(sides_of))


def least_rectangles(points: DataFrame, key: str = "line") -> DataFrame:
    """key, corners of the hull, and area, length, width of the least rectangle around it, one of whose sides lies on
    the hull; of equal ones that on the side of least coordinates. ax, ay is the way of its longer side, null where
    there is no width or the longer side is under 1.2 times the other."""
    n = F.expr("(qx - px) * (qx - px) + (qy - py) * (qy - py)")
    area = F.coalesce((F.col("along") * F.col("across")).cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    best = sides(points, key).withColumns({"n": n, "area": area}).groupBy(key).agg(F.count("*").alias("corners"), F.min(F.struct("area", "px", "py", "qx", "qy", "n", "along", "across")).alias("r")).select(key, "corners", "r.*")
    m = F.nullif(F.sqrt("n"), F.lit(0.0))
    more, less = F.greatest("along", "across"), F.least("along", "across")
    axis = (less > 0) & (5 * more >= 6 * less)
    dx, dy = F.expr("qx - px"), F.expr("qy - py")
    wide = F.col("along") >= F.col("across")
    return best.select(
        key, "corners", "area", F.coalesce(more / m, F.lit(0.0)).alias("length"), F.coalesce(less / m, F.lit(0.0)).alias("width"),
        F.when(axis, F.when(wide, dx).otherwise(-dy)).alias("ax"), F.when(axis, F.when(wide, dy).otherwise(dx)).alias("ay"),
    )
