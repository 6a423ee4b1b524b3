"""The catalogue as CSV, rules as YAML, and the store of parts with their boxes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

CATALOG = "dn int, capacity decimal(12,2), max_length decimal(18,9), new_price decimal(12,2), rebuild_price decimal(12,2), shell decimal(6,3), gap decimal(6,3), width decimal(6,3), height decimal(6,3)"
# The rules that hold unless a file says otherwise.
DEFAULTS: dict[str, Any] = {
    "input.unknown_restriction": "skip",
    "geometry.chamber_radius_m": 10.0,
    "geometry.chamber_radius_inclusive": True,
    "geometry.chamber_radius_margin_m": 0.1,
    "geometry.numeric_epsilon_m": 1e-6,
    "geometry.snap_m": 0.1,
    "cost.tie_in_rub": 5_000_000,
    "cost.penalty_fixed_rub": 100_000_000,
    "cost.penalty_per_tph_rub": 500_000,
    "depth.normal_m": 3.0,
    "depth.cover_m": 0.7,
    "depth.slope": 0.1,
}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The pipes of a CSV file with a header, one row a dn; a row that doesn't fit fails the read."""
    return spark.read.schema(CATALOG).option("header", True).option("mode", "FAILFAST").csv(path)


def _flat(tree: Mapping, prefix: str = ""):
    for k, v in tree.items():
        yield from _flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else [(f"{prefix}{k}", v)]


def rules(text: str = "") -> dict[str, Any]:
    """The rules as dotted keys: the defaults, overlaid by a YAML text. An unknown key or a value of another kind
    than its default is an error."""
    import yaml

    found = dict(DEFAULTS)
    for k, v in _flat(yaml.safe_load(text) or {}):
        if k not in found:
            raise ValueError(f"unknown rule {k}")
        kinds = (int, float) if type(found[k]) in (int, float) else (type(found[k]),)
        if not isinstance(v, kinds) or (isinstance(v, bool) and bool not in kinds):
            raise ValueError(f"rule {k} has a value of another kind: {v!r}")
        found[k] = v
    return found


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts with their boxes, one folder per scene, near each other in a file: readers skip by box."""
    points = F.flatten("rings")
    edge = lambda f, c: f(F.transform(points, lambda p: p[c]))
    boxed = parts.withColumns({"min_x": edge(F.array_min, "x"), "min_y": edge(F.array_min, "y"), "max_x": edge(F.array_max, "x"), "max_y": edge(F.array_max, "y")})
    order = ["scene_id", F.floor(F.col("min_x") / 1000), F.floor(F.col("min_y") / 1000), "id"]
    boxed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("scene_id").parquet(path)


def window(parts: DataFrame, scene: str, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """The stored parts of a scene whose boxes meet a window: a filter that reaches the scan."""
    meets = (F.col("min_x") <= x2) & (F.col("max_x") >= x1) & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)
    return parts.where((F.col("scene_id") == scene) & meets)


def by_id(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """The objects that have one of the wanted (scene_id, id)."""
    return objects.join(wanted.select("scene_id", "id").distinct(), ["scene_id", "id"], "left_semi")
