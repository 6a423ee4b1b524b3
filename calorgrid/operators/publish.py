"""What is published of a search: sound variants, ranked again, or the plain truth that nothing is connected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.functions import pricing


def gate(variants: DataFrame, violations: DataFrame, demands: DataFrame) -> DataFrame:
    """scene_id, variant_id, missing, cost, score, rank and fallback of what may be published.

    Variants (scene_id, variant_id, missing, cost, score) with a violation go; of the others those that connect the
    most consumers stay, ranked by score. A scene of which none is left gets one variant without pipes: every
    consumer (scene_id, demand, flow) unconnected, at the price of the penalties.
    """
    sound = variants.join(violations.select("scene_id", "variant_id").distinct(), ["scene_id", "variant_id"], "left_anti")
    least = F.min("missing").over(Window.partitionBy("scene_id"))
    sound = sound.withColumn("_least", least).where("missing = _least").drop("_least")
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("score", "variant_id"))
    kept = sound.select("scene_id", F.col("variant_id").cast("string").alias("variant_id"), "missing", "cost", "score", rank.alias("rank"), F.lit(False).alias("fallback"))
    lost = demands.join(sound.select("scene_id").distinct(), "scene_id", "left_anti").groupBy("scene_id")
    lost = lost.agg(F.count("*").alias("missing"), F.sum(pricing.penalty(F.col("flow"))).cast("decimal(18,2)").alias("cost"))
    score = pricing.score(F.col("cost"), F.lit(0))
    return kept.union(lost.select("scene_id", F.lit("none").alias("variant_id"), "missing", "cost", score.alias("score"), F.lit(1).alias("rank"), F.lit(True).alias("fallback")))
