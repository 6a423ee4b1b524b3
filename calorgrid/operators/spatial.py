"""Joins of things near each other in the plane, by equal cells of a grid.

Each side is put into every cell that its box, widened by the distance asked for, meets; a pair is kept in the
one cell that holds the lower corner of the boxes' intersection, so no distinct() is needed. The join is an
equi-join that Spark shuffles and splits when skewed. It is told to: the planner knows the size of the files only, not
how many cells a box meets, so it would send tables of any size through the driver, and leave all pairs to the few
tasks that read the other side.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from calorgrid.functions import geometry
from calorgrid.operators.lineage import cut


def _cells(df: DataFrame, box: tuple[Column, Column, Column, Column], cell: int | Column, prefix: str) -> DataFrame:
    low = [F.floor(c / cell).cast("long") for c in box]
    out = df.withColumns({f"_{prefix}{i}": c for i, c in enumerate(box)})
    out = out.withColumn("_cx", F.explode(F.sequence(low[0], low[2])))
    return out.withColumn("_cy", F.explode(F.sequence(low[1], low[3])))


def near(left: DataFrame, right: DataFrame, box: tuple, other: tuple, cell: int | Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs whose boxes (min x, min y, max x, max y as columns of their side) meet, ends included. A cell that depends
    on the keys is a column, which both sides have under one name and the keys name too."""
    a, b = _cells(left, box, cell, "l"), _cells(right, other, cell, "r")
    joined = a.join(b.hint("merge"), ["_cx", "_cy", *(keys or [])])
    meet = (F.col("_l0") <= F.col("_r2")) & (F.col("_r0") <= F.col("_l2")) & (F.col("_l1") <= F.col("_r3")) & (F.col("_r1") <= F.col("_l3"))
    home = (F.col("_cx") == F.floor(F.greatest("_l0", "_r0") / cell)) & (F.col("_cy") == F.floor(F.greatest("_l1", "_r1") / cell))
    drop = ["_cx", "_cy", *(f"_{s}{i}" for s in "lr" for i in range(4))]
    return joined.where(meet & home).drop(*drop)


def own_cells(sides: DataFrame, ends: tuple[str, str, str, str], key: str = "line", most: int = 128) -> DataFrame:
    """Add _cell, the cells in which the sides of each line (ends ax, ay, bx, by) meet those of the same: so wide that
    a line of up to `most` sides lies in about one, and as many as suit its sides otherwise. Most lines are short, and
    narrower cells would multiply their sides to part few pairs."""
    of = Window.partitionBy(key)
    ax, ay, bx, by = ends
    wide, high = (F.max(F.greatest(a, b)).over(of) - F.min(F.least(a, b)).over(of) for a, b in ((ax, bx), (ay, by)))
    n = F.floor(F.sqrt(F.count("*").over(of) / most))
    return sides.withColumn("_cell", F.floor(F.greatest(wide, high) / F.greatest(n, F.lit(1))).cast("long") + 1)


def copies(rows: DataFrame, name: str, shape: list[str], most: int = 1024) -> DataFrame:
    """The names of the rows of each shape, in lists `_names` of about `most` at the most: shapes that occur many times
    are met once, and pairs of them are spread over their names at the end, within tasks."""
    top = rows.groupBy(*shape).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64(name), F.lit(top // most + 1))
    return rows.groupBy(*shape, part.alias("_part")).agg(F.collect_list(name).alias("_names")).drop("_part")


def alike(rows: DataFrame, name: str, shape: list[str]) -> tuple[DataFrame, DataFrame]:
    """The shapes, each under the least name that has it, and the names of all rows (`_names`, short lists) by that."""
    shapes = cut(rows.groupBy(*shape).agg(F.min(name).alias(name)))
    of = rows.select(*shape, F.col(name).alias("_each")).join(shapes.hint("merge"), shape)
    return shapes, copies(of, "_each", [name])


def pairs_of_lines(lines: DataFrame, ends: list[str], margin: int, measure: Callable, out: str, more: list[str], where: str = "true", cell: int = 200) -> DataFrame:
    """Pairs of lines (rows of `ends`, integers, and the columns `more`, all of them different) whose boxes are within
    `margin`, each pair once and the greater row as o_, with `out`, a name and its type: `measure` of the four ends of
    both, pairs of numpy columns."""
    columns = [*ends, *more]
    other = lines.select(*[F.col(c).alias(f"o_{c}") for c in columns])
    ax, ay, bx, by = map(F.col, ends)
    ox, oy, px, py = (F.col(f"o_{c}") for c in ends)
    box = (F.least(ax, bx) - margin, F.least(ay, by) - margin, F.greatest(ax, bx) + margin, F.greatest(ay, by) + margin)
    pairs = near(lines.select(*columns), other, box, (F.least(ox, px), F.least(oy, py), F.greatest(ox, px), F.greatest(oy, py)), cell)
    pairs = pairs.where(F.struct(*columns) < F.struct(*[f"o_{c}" for c in columns])).where(where)

    def measured(parts):
        for part in parts:
            at = [part.column(f"{o}{c}").to_numpy() for o in ("", "o_") for c in ends]
            got = measure(*zip(at[::2], at[1::2]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*part.schema.names, out.split()[0]])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    return pairs.mapInArrow(measured, f"{kinds}, {out}")


def inside(points: DataFrame, edges: DataFrame, cell: int, keys: list[str] | None = None) -> DataFrame:
    """point and ring of points inside rings: points (point, x, y), edges (ring, x1, y1, x2, y2), exact for integers;
    only those with equal `keys`, columns of both, meet.

    Points first meet the boxes of rings by cells; only such pairs meet the ring's edges, by bands of height, and
    a ray to the left is counted against the edges that reach the point's height, half open, so holes that share
    the ring's id cut out.
    """
    keys = keys or []
    box = edges.groupBy(*keys, "ring").agg(
        F.min(F.least("x1", "x2")).alias("_x1"), F.min(F.least("y1", "y2")).alias("_y1"),
        F.max(F.greatest("x1", "x2")).alias("_x2"), F.max(F.greatest("y1", "y2")).alias("_y2"),
    )
    at = tuple(F.col(c) for c in ("x", "y", "x", "y"))
    pairs = near(points.select(*keys, "point", "x", "y"), box, at, tuple(F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")), cell, keys)
    band = lambda y: F.floor(y / cell).cast("long")
    p = pairs.select(*keys, "point", "ring", "x", "y", band(F.col("y")).alias("_band"))
    e = edges.where("y1 <> y2").withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    up = (F.col("y1") <= F.col("y")) & (F.col("y") < F.col("y2"))
    down = (F.col("y2") <= F.col("y")) & (F.col("y") < F.col("y1"))
    side = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    # the edge lies right of the point if the point is left of it going up, right of it going down
    hit = (up & (side > 0)) | (down & (side < 0))
    met = p.join(e.hint("merge"), [*keys, "ring", "_band"]).where(hit).groupBy(*keys, "point", "ring").agg(F.count("*").alias("_n"))
    return met.where("_n % 2 = 1").select(*keys, "point", "ring")


def pieces(lines: DataFrame, edges: DataFrame, cell: int, least: float = 1e-6) -> DataFrame:
    """The pieces of straight lines (line, ax, ay, bx, by_) inside rings (ring, x1, y1, x2, y2): line, ring, entry and
    exit (m along the line), from the first piece on as `piece`, steep (whether it enters at 45 degrees or more; null
    where the line begins inside) and single (whether the line has this piece of the ring alone).

    The sides that the endless line crosses, half open, are even in number, so in order of their places the first and
    second bound a piece, the third and fourth the next; holes share the ring's id. What lies beyond the line's ends is
    cut off, and pieces of up to `least` metres are touches and no pieces. A side that the line runs along belongs to
    what lies left of the line. Lines meet the sides of those rings whose boxes they meet.
    """
    a, b, p, q = (tuple(F.col(c) for c in n) for n in (("ax", "ay"), ("bx", "by_"), ("x1", "y1"), ("x2", "y2")))
    box = edges.groupBy("ring").agg(
        F.min(F.least("x1", "x2")).alias("_x1"), F.min(F.least("y1", "y2")).alias("_y1"),
        F.max(F.greatest("x1", "x2")).alias("_x2"), F.max(F.greatest("y1", "y2")).alias("_y2"),
    )
    span = (F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[0], b[0]), F.greatest(a[1], b[1]))
    pairs = near(lines.select("line", *a, *b), box, span, tuple(F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")), cell)
    met = pairs.select("line", *a, *b, "ring").join(edges.select("ring", *p, *q).hint("merge"), "ring")
    met = met.where((geometry.turn(*a, *b, *p) > 0) != (geometry.turn(*a, *b, *q) > 0))
    det = (b[0] - a[0]) * (q[1] - p[1]) - (b[1] - a[1]) * (q[0] - p[0])
    t = ((p[0] - a[0]) * (q[1] - p[1]) - (p[1] - a[1]) * (q[0] - p[0])).cast("double") / det.cast("double")
    length = F.sqrt(((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])).cast("double"))
    met = met.select("line", "ring", t.alias("_t"), length.alias("_m"), geometry.steep(a, b, p, q).alias("steep"), "x1", "y1", "x2", "y2")
    way = Window.partitionBy("line", "ring").orderBy("_t", "x1", "y1", "x2", "y2")
    both = met.withColumns({"_n": F.row_number().over(way), "_out": F.lead("_t").over(way)}).where("_n % 2 = 1 and _out > 0 and _t < 1")
    cut_ = both.select(
        "line", "ring", (F.when(F.col("_t") > 0, F.col("_t")).otherwise(0.0) * F.col("_m")).alias("entry"), (F.least("_out", F.lit(1.0)) * F.col("_m")).alias("exit"),
        F.when(F.col("_t") >= 0, F.col("steep")).alias("steep"),
    ).where(F.col("exit") - F.col("entry") > least)
    of = Window.partitionBy("line", "ring")
    return cut_.withColumns({"piece": F.row_number().over(of.orderBy("entry")), "single": F.count("*").over(of) == 1})


def _start(area: float, n: int, k: int, most: int) -> int:
    """Half the side of a square that holds 2 k of n things dealt evenly over an area; 1 to `most`."""
    return max(1, min(most, int((k * area / (2 * max(n, 1))) ** 0.5)))


def nearest(points: DataFrame, others: DataFrame, box: tuple, score: Column, reach: Column, k: int, cell: int, tie: str) -> DataFrame:
    """The k nearest of `others` to each point (point, x, y), ties to the least `tie`: the pairs with `rank`.

    `box` is the box of an other, `score` orders pairs (a distance or its square) and `reach` is the score of the
    distance `r`, a column. Rings of cells are searched in rounds of double the radius, the first of which is `cell` or
    less where others stand dense, so that a point meets about as many of them in a large table as in a small one. A
    point is done when k are within the radius searched, or when the radius holds all others. Only unfinished points
    go on.
    """
    ends = others.agg(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3]), F.count("*")).first()
    if ends[0] is None:
        return near(points, others, tuple(F.col(c) for c in ("x", "y", "x", "y")), box, cell).withColumn("rank", F.lit(1))
    found, left = None, points
    r = _start(float(ends[2] - ends[0]) * float(ends[3] - ends[1]), ends[4], k, cell)
    own = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    whole = max(abs(a - b) for a in ends[:4] for b in own if b is not None) if own[0] is not None else 0
    best = Window.partitionBy("point").orderBy("_score", tie)
    while True:
        at = (F.col("x") - r, F.col("y") - r, F.col("x") + r, F.col("y") + r)
        pairs = near(left, others, at, box, r).withColumn("_score", score).withColumn("r", F.lit(r))
        if r < whole:  # what lies beyond the radius may be farther than things that no pair shows yet
            pairs = pairs.where(F.col("_score") <= reach)
        ranked = cut(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if r >= whole:
            done = ranked
        else:
            full = ranked.where(F.col("rank") == k).select("point")
            done = ranked.join(full, "point", "left_semi")
            left = cut(left.join(full, "point", "left_anti"))
        done = done.drop("_score", "r")
        found = done if found is None else found.unionByName(done)
        if r >= whole or left.isEmpty():
            return found
        r *= 2


def along(lines: DataFrame, cell: int, margin: float = 0, by: str = "by_") -> DataFrame:
    """Lines in the cells _cx, _cy that they pass or come within `margin` of: per column of cells those between the
    heights at its two sides, a little widened, so a line has as many rows as it passes cells and not as its box has."""
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    column = F.explode(F.sequence(F.floor((low - margin) / cell).cast("long"), F.floor((high + margin) / cell).cast("long")))
    out = lines.withColumn("_cx", column)
    slope = (F.col(by) - F.col("ay")).cast("double") / F.nullif((F.col("bx") - F.col("ax")).cast("double"), F.lit(0.0))

    def height(x: Column) -> Column:
        return F.col("ay") + (F.least(F.greatest(x, low), high) - F.col("ax")) * slope

    sides = height(F.col("_cx") * cell - margin), height((F.col("_cx") + 1) * cell + margin)
    level = F.col("ax") == F.col("bx")
    below = F.when(level, F.least("ay", by).cast("double")).otherwise(F.least(*sides) - 1e-6 * cell) - margin
    above = F.when(level, F.greatest("ay", by).cast("double")).otherwise(F.greatest(*sides) + 1e-6 * cell) + margin
    return out.withColumn("_cy", F.explode(F.sequence(F.floor(below / cell).cast("long"), F.floor(above / cell).cast("long"))))


def nearest_line(points: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """point, line and d2, the least squared distance of each point (point, x, y) from lines (line, ax, ay, bx, by_), of
    equal ones the least line; points with none within `most` have no row. For integer coordinates.

    Rounds search a radius of four times the last up to `most`, from one that suits the density of lines; a point is
    done when a line is within the radius, and only the others go on. Lines stand in the cells that they pass and
    points in those that their radius meets, so a pair may meet in several cells, which the least of a point bears.
    """
    ends = lines.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by_")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by_")), F.count("*")).first()
    area = float(ends[2] - ends[0]) * float(ends[3] - ends[1]) if ends[0] is not None else 1.0
    cell = max(1, min(most, int(3 * (area / max(ends[4], 1)) ** 0.5)))
    d2 = geometry.distance2(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by_")])
    found, left, r = None, points.select("point", "x", "y"), max(1, min(most, cell // 4))
    while True:
        cell = max(cell, r)
        span = lambda c, r=r, cell=cell: F.explode(F.sequence(F.floor((F.col(c) - r) / cell).cast("long"), F.floor((F.col(c) + r) / cell).cast("long")))
        at = left.withColumn("_cx", span("x")).withColumn("_cy", span("y"))
        pairs = at.join(along(lines, cell).hint("merge"), ["_cx", "_cy"]).select("point", "line", d2.alias("d2")).where(F.col("d2") <= r * r)
        # the least distance first and then the least line that has it, as a least pair would be found by a sort
        best = pairs.groupBy("point", "d2").agg(F.min("line").alias("line"))
        best = cut(best.groupBy("point").agg(F.min_by("line", "d2").alias("line"), F.min("d2").alias("d2")))
        found = best if found is None else found.union(best)
        if r >= most:
            return found
        left = cut(left.join(best.select("point"), "point", "left_anti"))
        if left.isEmpty():
            return found
        r = min(most, 4 * r)
