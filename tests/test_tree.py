"""Trees deeper than the level from which they are counted."""

import pytest

from calorgrid.operators import tree


def test_deep_chain(spark, monkeypatch):
    for name in ("MAX_LEVELS", "COUNT_AT"):
        monkeypatch.setattr(tree, name, 3, raising=False)
    nodes = spark.range(7).selectExpr("id AS node", "nullif(id, 0) - 1 AS parent")
    assert {r["node"]: r["depth"] for r in tree.levels(nodes).collect()} == {k: k for k in range(7)}


def test_two_parents_on_a_cycle(spark, monkeypatch):
    monkeypatch.setattr(tree, "COUNT_AT", 3, raising=False)
    nodes = spark.createDataFrame([(0, None), (1, 0), (1, 2), (2, 1)], "node long, parent long")
    with pytest.raises(RuntimeError):
        tree.levels(nodes)
