"""Distances of segments on numpy columns of integers, for the pairs of large joins: as column expressions they are
longer than what the JVM compiles, and each pair took tens of microseconds."""

from __future__ import annotations

import numpy as np

LIMIT = 1 << 15  # of differences of coordinates, so that squares of areas are exact


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    if len(d) and max(d.max(), -d.min()) > LIMIT:
        raise OverflowError(f"coordinates are more than {LIMIT} apart")
    return d


def _from(p, a, b) -> tuple[np.ndarray, ...]:
    """Of p and segment a-b: whether its foot lies between the ends, the least square from an end, and the square of
    the distance from the endless line as a fraction."""
    dx, dy, ex, ey = _difference(b[0], a[0]), _difference(b[1], a[1]), _difference(p[0], a[0]), _difference(p[1], a[1])
    fx, fy = _difference(p[0], b[0]), _difference(p[1], b[1])
    n, u, cross = dx * dx + dy * dy, ex * dx + ey * dy, ex * dy - ey * dx
    return (u > 0) & (u < n), np.minimum(ex * ex + ey * ey, fx * fx + fy * fy), cross * cross, n


def _ends(a, b, c, d) -> list[tuple[np.ndarray, ...]]:
    return [_from(a, c, d), _from(b, c, d), _from(c, a, b), _from(d, a, b)]


def _side(p, q, r) -> np.ndarray:
    return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def gap2(a, b, c, d) -> np.ndarray:
    """The square of the distance between segments a-b and c-d (pairs of columns), 0 where they meet."""
    least = None
    for between, end, cross2, n in _ends(a, b, c, d):
        d2 = np.where(between, cross2.astype("float64") / np.maximum(n, 1), end.astype("float64"))
        least = d2 if least is None else np.minimum(least, d2)
    crosses = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
    return np.where(crosses, 0.0, least)


def ends_within(a, b, c, d, r: int) -> np.ndarray:
    """Whether an end of a-b is within r of c-d, or one of c-d within r of a-b."""
    return np.logical_or.reduce([np.where(between, cross2 <= r * r * n, end <= r * r) for between, end, cross2, n in _ends(a, b, c, d)])
