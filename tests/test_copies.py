"""Pairs of shapes that occur more than once: the SQL of copies of a table, and shapes met once."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

import calorgrid.plans  # noqa: F401
from calorgrid.functions import batches, geometry
from calorgrid.operators import spatial
from calorgrid.queries import ORACLES, QUERIES
from tests.compare import connect, same


@pytest.fixture(scope="module")
def twice(spark, sf_dir, tmp_path_factory):
    """Customers and parts three times, with keys shifted by a period of the stand-ins' coordinates."""
    to = tmp_path_factory.mktemp("twice")
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.col(key) < 60)
        t = t.withColumn(key, F.explode(F.array(*[F.col(key) + 10000 * i for i in range(3)])))
        t.coalesce(1).write.parquet(f"{to}/_{name}")
        part = next(f for f in os.listdir(f"{to}/_{name}") if f.endswith(".parquet"))
        shutil.copy(f"{to}/_{name}/{part}", f"{to}/{name}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["cell_join", "segment_crossings", "crossing_points", "edge_conflicts"])
def test_copies(spark, twice, monkeypatch, name):
    met = []
    near = spatial.near
    monkeypatch.setattr(spatial, "near", lambda a, b, *more: met.append(b.count()) or near(a, b, *more))
    assert same(QUERIES[name](spark, twice), connect(twice), ORACLES[name]) > 0
    assert met == [60]  # before, all 180


def test_lists_are_short(spark):
    rows = spark.range(5000).select("id", F.lit(1).alias("x"))
    got = spatial.copies(rows, "id", ["x"], 100).select(F.size("_names").alias("n")).collect()
    assert sum(r["n"] for r in got) == 5000 and max(r["n"] for r in got) < 300


def test_margin_of_copies(spark, twice, monkeypatch):
    met = []
    near = spatial.near
    monkeypatch.setattr(spatial, "near", lambda a, b, *more: met.append(b.count()) or near(a, b, *more))
    assert same(QUERIES["clearance_margin"](spark, twice), connect(twice), ORACLES["clearance_margin"]) > 0
    assert met == [60]  # before, all 180


def test_batches(spark):
    """Numpy columns against the column expressions: lines that cross, touch, lie on each other, points."""
    rng = random.Random(4)
    rows = [tuple(rng.randrange(-6, 7) * m for _ in range(8)) for m in (1, 1, 50) for _ in range(700)] + [(1, 2, 1, 2, 1, 2, 1, 2), (0, 0, 4, 0, 2, 0, 9, 0), (0, 0, 4, 4, 0, 4, 4, 0)]
    quad = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (F.col("e"), F.col("f")), (F.col("g"), F.col("h"))]
    near = lambda p, q: geometry.within(*p, *q[0], *q[1], F.lit(3))
    ends = near(quad[0], quad[2:]) | near(quad[1], quad[2:]) | near(quad[2], quad[:2]) | near(quad[3], quad[:2])
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in "abcdefgh")).select(*"abcdefgh", geometry.gap2(*quad).alias("gap"), ends.alias("ends"))
    got = df.toPandas()
    at = [(got[p].to_numpy(), got[q].to_numpy()) for p, q in ("ab", "cd", "ef", "gh")]
    assert (batches.gap2(*at) == got["gap"]).all() and (batches.ends_within(*at, 3) == got["ends"]).all()
    assert 50 < got["ends"].sum() < 2000 and (got["gap"] == 0).sum() > 50
    with pytest.raises(OverflowError):
        batches.gap2(*[(p + (1 << 20) * k, q) for k, (p, q) in enumerate(at)])


@pytest.mark.parametrize("name", ["point_in_polygon", "part_overlap", "polygon_pieces"])
def test_copies_of_boxes(spark, twice, monkeypatch, name):
    met = []
    near = spatial.near
    monkeypatch.setattr(spatial, "near", lambda a, b, *more: met.append((a.count(), b.count())) or near(a, b, *more))
    assert same(QUERIES[name](spark, twice), connect(twice), ORACLES[name]) > 0
    assert met == [(180 if name == "point_in_polygon" else 60, 60)]  # before, all 180 boxes
