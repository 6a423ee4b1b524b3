"""Joins of rows with one row per key, where a few keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT = 1 << 16  # rows of a key from which it is spread
MAX_HOT = 4096  # keys that are spread, those with the most rows; others have at most 1 / MAX_HOT of all rows each
SALTS = 64


def spread_join(rows: DataFrame, grouped: DataFrame, keys: list[str], count: str, by: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `grouped`, which has one row per key and says in `count` how many rows the key has.

    The rows of a hot key are dealt over SALTS places by a hash of the column `by`; its row of `grouped` goes to
    each of them. The list of hot keys, at most MAX_HOT rows, is broadcast. `grouped` is read twice.
    """
    top = grouped.where(F.col(count) > HOT).orderBy(F.desc(count), *keys).limit(MAX_HOT)
    hot = F.broadcast(top.select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = grouped.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
