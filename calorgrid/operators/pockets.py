"""Free space closed in by walls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from calorgrid.operators import graph, intervals, spatial
from calorgrid.operators.lineage import cut

STEP = 64  # columns of the cells in which runs of neighbouring rows meet
HIGH = 128  # rows of a tile
MOST = 1 << 13  # walls and supplies of a tile that one task may hold; a scene with a tile of more goes by joins of runs
OUTER = -(1 << 63)  # the row of the node that stands for a scene's outer region


def free_runs(walls: DataFrame, key: str = "scene") -> DataFrame:
    """key, y, a, b: the stretches [a, b) of each row y of unit cells that no wall covers, from one row and column
    before a scene's first wall to one after its last. walls has key and integers x1, y1, x2, y2."""
    walls = walls.where("x1 < x2 and y1 < y2")
    rows = walls.select(key, F.col("x1").alias("a"), F.col("x2").alias("b"), F.explode(F.expr("sequence(y1, y2 - 1)")).alias("y"))
    solid = intervals.islands(rows, [key, "y"]).select(key, "y", "a", "b")
    frame = walls.groupBy(key).agg((F.min("x1") - 1).alias("lo"), (F.max("x2") + 1).alias("hi"), (F.min("y1") - 1).alias("low"), F.max("y2").alias("high"))
    sides = frame.select(key, F.explode(F.sequence("low", "high")).alias("y"), F.array("lo", "hi").alias("a"))
    sides = sides.select(key, "y", F.explode("a").alias("a")).select("*", F.col("a").alias("b"))
    ends = intervals.following(cut(solid.union(sides)), [key, "y"], "a", "_to")
    return ends.where("_to > b").select(key, "y", F.col("b").alias("a"), F.col("_to").alias("b"))


def pockets(walls: DataFrame, supplies: DataFrame, key: str = "scene") -> DataFrame:
    """key, x, y, area and supplied of each pocket: free cells that no way over the sides of free cells leads out of;
    x and y are those of its first cell by row and column, supplied is whether one of `supplies` (key, x, y) stands
    in it. Walls that touch by a corner shut the way between them.

    Scenes are cut into tiles of HIGH rows, over the whole width, and each wall is sent to those that it meets: the
    regions of a tile are found in one task, and only those that reach into its neighbours are joined to theirs. The
    outer region is the one that holds the row or column before the first wall or after the last. A wall without
    extent, or with a null, is none.
    """
    kind = dict(walls.dtypes)[key]
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    walls = walls.where(F.col(key).isNotNull()).where("x1 < x2 and y1 < y2").select(key, *long("x1", "y1", "x2", "y2"))
    at = supplies.select(F.col(key).cast(kind).alias(key), *long("x", "y")).where(F.col(key).isNotNull()).where("x is not null and y is not null").distinct()
    tile = lambda c: F.floor(c / HIGH).cast("long")
    frame = walls.groupBy(key).agg((F.min("x1") - 1).alias("x1"), (F.min("y1") - 1).alias("y1"), (F.max("x2") + 1).alias("x2"), F.max("y2").alias("y2"))
    tiled = lambda rows, is_, last: rows.select(key, F.explode(F.sequence(tile(F.col("y1")), tile(last))).alias("_tile"), F.lit(is_).alias("_is"), "x1", "y1", "x2", "y2")
    points = at.select(key, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = tiled(frame, 0, F.col("y2")).union(tiled(walls, 1, F.col("y2") - 1)).union(tiled(points, 2, F.col("y2")))
    many = cut(rows.groupBy(key, "_tile").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select(key).distinct())
    if many.isEmpty():
        return _by_tiles(rows, key, kind)
    few = _by_tiles(rows.join(many, key, "left_anti"), key, kind)
    return few.union(_by_runs(walls.join(many, key, "left_semi"), at.join(many, key, "left_semi"), key))


def _by_tiles(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """The pockets from rows of tiles: key, _tile, _is (0: the scene's frame, 1: a wall, 2: a supply), x1, y1, x2, y2."""
    height = HIGH
    dealt = rows.repartition(key, "_tile").sortWithinPartitions(key, "_tile", "_is")
    found = cut(dealt.mapInArrow(lambda parts: _tiles(parts, key, height), f"`{key}` {kind}, _end int, y long, x long, area long, has boolean, open boolean, _row long, a long, b long"))
    own = found.where("_end = 0")
    whole = own.where("not open").select(key, "x", "y", "area", F.col("has").alias("supplied"))
    ends = lambda n: found.where(F.col("_end") == n).select(key, "_row", F.col("a").alias(f"_a{n}"), F.col("b").alias(f"_b{n}"), F.struct(key, "y", "x").alias("ab"[n - 1]))
    flat = lambda a, b: (F.col(a), F.lit(0), F.col(b) - 1, F.lit(0))
    links = spatial.near(ends(1), ends(2), flat("_a1", "_b1"), flat("_a2", "_b2"), STEP, [key, "_row"]).where("a <> b").select("a", "b")
    parted = own.where("open").select(F.struct(key, "y", "x").alias("node"), "area", "has")
    label = graph.components(links, parted.select("node")).where(F.col("label.y") > OUTER)
    joined = parted.join(label, "node").groupBy("label").agg(F.sum("area").alias("area"), F.max("has").alias("supplied"))
    return whole.union(joined.select(f"label.{key}", "label.x", "label.y", "area", "supplied"))


def _tiles(parts: Iterator[pa.RecordBatch], key: str, height: int) -> Iterator[pa.RecordBatch]:
    """Regions (_end 0) of the tiles that follow each other in sorted rows, and runs of free cells in the last (1) and
    first (2) row of a tile, whose `_row` is the upper row of the border, with their regions."""
    left = None
    for part in parts:
        rows = pa.Table.from_batches([part])
        rows = rows if left is None else pa.concat_tables([left, rows])
        if rows.num_rows:
            starts = _starts(rows, key)
            left = rows.slice(starts[-1])
            if starts[-1]:
                yield from _regions(rows.slice(0, starts[-1]), starts[:-1], key, height)
    if left is not None and left.num_rows:
        yield from _regions(left, np.zeros(1, "int64"), key, height)


def _starts(rows: pa.Table, key: str) -> np.ndarray:
    n, tile = rows.num_rows, rows["_tile"].to_numpy()
    other = np.asarray(pc.not_equal(rows[key].slice(1), rows[key].slice(0, n - 1))) | (tile[1:] != tile[:-1])
    return np.concatenate([[0], np.flatnonzero(other.astype(bool)) + 1])


def _spans(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the n numbers from `first` on: the place of that first, and the number."""
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n items with links i-j the least item that each is linked with."""
    least = np.arange(n)
    while True:
        p, q = least[i], least[j]
        apart = p != q
        if not apart.any():
            return least
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(shorter := least[least], least):
            least = shorter


def _regions(rows: pa.Table, starts: np.ndarray, key: str, height: int) -> Iterator[pa.RecordBatch]:
    is_, x1, y1, x2, y2, number = (rows[c].to_numpy() for c in ("_is", "x1", "y1", "x2", "y2", "_tile"))
    framed = is_[starts] == 0  # supplies beyond the walls of their scene stand in no frame
    of = np.repeat(np.where(framed, np.cumsum(framed) - 1, -1), np.diff(np.append(starts, len(is_))))
    at = starts[framed]
    if not len(at):
        return
    lo, low, hi, high, top = x1[at], y1[at], x2[at], y2[at], number[at] * height
    first, last = np.maximum(low, top), np.minimum(high, top + height - 1)
    begin = np.cumsum(last - first + 1) - (last - first + 1)  # rows of all tiles are numbered
    tile_of, y_of = _spans(first, last - first + 1)
    wide = int((hi - lo).max()) + 2
    if wide * len(y_of) >= 1 << 62:
        raise OverflowError("a scene is too wide")
    # walls as stretches of rows, on one line of all rows; each row has one without extent at either end
    w = np.flatnonzero((is_ == 1) & (of >= 0))
    t = of[w]
    a, b = np.maximum(y1[w], top[t]), np.minimum(y2[w], top[t] + height)
    wall, y = _spans(a, b - a)
    line = lambda t, y, x: (begin[t] + y - first[t]) * wide + x - lo[t]
    frame = [line(tile_of, y_of, side[tile_of]) for side in (lo, hi)]
    a = np.concatenate([line(t[wall], y, x1[w][wall]), *frame])
    b = np.concatenate([line(t[wall], y, x2[w][wall]), *frame])
    order = np.argsort(a)
    a, b = a[order][1:], np.maximum.accumulate(b[order])[:-1]
    free = (b < a) & (b // wide == a // wide)
    a, b = b[free], a[free]
    row = a // wide
    t, y = tile_of[row], y_of[row]
    x, to = a - row * wide + lo[t], b - row * wide + lo[t]
    up = np.flatnonzero(y < last[t])
    j = np.searchsorted(b, a[up] + wide, "right")
    i, j = _spans(j, np.maximum(np.searchsorted(a, b[up] + wide, "left") - j, 0))
    region = _least(len(a), up[i], j)
    outer, open_, has = np.zeros(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a), bool)
    outer[region[(x == lo[t]) | (to == hi[t]) | (y <= low[t] + 1) | (y >= high[t] - 1)]] = True
    # what lies next to the first or last row, which are free, is known to be outside
    ends = [np.flatnonzero((y == last[t]) & (y > low[t]) & (y < high[t] - 1)), np.flatnonzero((y == first[t]) & (y > low[t] + 1) & (y < high[t]))]
    open_[region[np.concatenate(ends)]] = True
    p = np.flatnonzero((is_ == 2) & (of >= 0))
    p = p[(y1[p] >= first[of[p]]) & (y1[p] <= last[of[p]]) & (x1[p] >= lo[of[p]]) & (x1[p] < hi[of[p]])]
    place = line(of[p], y1[p], x1[p])
    run = np.searchsorted(a, place, "right") - 1
    has[region[run[(run >= 0) & (place < b[run])]]] = True
    area = np.zeros(len(a), "int64")
    np.add.at(area, region, b - a)
    none = lambda n: np.zeros(n, "int64")
    keys = rows[key].combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys

    def said(end: int, runs: np.ndarray, of: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        out = outer[of]
        columns = [np.full(len(runs), end, "int32"), np.where(out, OUTER, y[of]), np.where(out, 0, x[of]), area[of], has[of], open_[of], *more]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at[t[runs]])), *map(pa.array, columns)], names=[key, "_end", "y", "x", "area", "has", "open", "_row", "a", "b"])

    own = np.flatnonzero((region == np.arange(len(a))) & ~outer)
    yield said(0, own, own, none(len(own)), none(len(own)), none(len(own)))
    for end, runs in enumerate(ends, 1):
        yield said(end, runs, region[runs], y[runs] - (end - 1), x[runs], to[runs])


def _by_runs(walls: DataFrame, supplies: DataFrame, key: str) -> DataFrame:
    """The pockets by joins alone. Rows are split into runs of free cells, so the work grows with the height of walls and
    not with areas; runs of neighbouring rows that share a column are linked, and components of runs are the regions.
    The outer region holds the row before the first wall, which is the scene's least run."""
    kinds = {"y": "long", "a": "long", "b": "long"}
    runs = cut(free_runs(walls, key).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}))
    node = F.struct(key, "y", "a")
    first = runs.select(key, F.col("y").alias("_row"), F.col("a").alias("_a1"), F.col("b").alias("_b1"), node.alias("a"))
    after = runs.select(key, (F.col("y") - 1).alias("_row"), F.col("a").alias("_a2"), F.col("b").alias("_b2"), node.alias("b"))
    flat = lambda a, b: (F.col(a), F.lit(0), F.col(b) - 1, F.lit(0))
    links = spatial.near(first, after, flat("_a1", "_b1"), flat("_a2", "_b2"), STEP, [key, "_row"]).select("a", "b")
    labels = graph.components(links, runs.select(node.alias("node")))
    of = cut(labels.select("node.*", "label").join(runs, [key, "y", "a"]))
    least = of.groupBy(key).agg(F.min("y").alias("_low"))
    closed = cut(of.join(least, key).where("label.y > _low").select(key, "y", "a", "b", "label"))
    at = supplies.select(key, F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_row"))
    run = closed.select(key, F.col("y").alias("_row"), "a", "b", "label")
    point = (F.col("_x"), F.lit(0), F.col("_x"), F.lit(0))
    has = spatial.near(run, at, flat("a", "b"), point, STEP, [key, "_row"]).select("label").distinct().withColumn("_has", F.lit(True))
    area = closed.groupBy("label").agg(F.sum(F.col("b") - F.col("a")).alias("area")).join(has, "label", "left")
    return area.select(f"label.{key}", F.col("label.a").alias("x"), "label.y", "area", F.coalesce("_has", F.lit(False)).alias("supplied"))
