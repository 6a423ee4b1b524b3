"""Snapped points against a plain loop: copies of a place, anchors, points without a place, few pairs a tile."""

import math

import pytest

from calorgrid.operators import network


def loop(points, snap):
    nodes, of = {}, {}
    for k, x, y, anchor in sorted(points):
        near = lambda p: math.hypot(p[0] - x, p[1] - y) <= snap
        fit = [n for n, m in sorted(nodes.items()) if all(map(near, m)) and (m[0][2] is None or anchor is None or m[0][2] == anchor)] if x is not None else []
        of[k] = fit[0] if fit else k
        if x is not None:
            nodes.setdefault(of[k], []).append((x, y, anchor))
    return of


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_snap_copies(spark, monkeypatch, most):
    monkeypatch.setattr(network, "MAX_PAIRS", most)
    points = [(k, (k * 7919) % 11 / 16, (k * 104729) % 3 / 16, (None, "a", None, "b")[k % 4]) for k in range(150)] + [(200, None, 0.0, None), (201, None, 0.0, None)]
    formed = []
    settle = network._snapped
    monkeypatch.setattr(network, "_snapped", lambda p, *a: formed.append(p.count()) or settle(p, *a))
    got = network.snap_points(spark.createDataFrame([("s", *p) for p in points], "scene_id string, k long, x double, y double, anchor string"), 0.13)
    assert {r["k"]: r["node"] for r in got.collect()} == loop(points, 0.13)
    assert formed == [len({p[1:] for p in points if p[1] is not None})]  # a place is settled once, not each of its copies
