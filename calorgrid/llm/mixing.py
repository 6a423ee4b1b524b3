"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Sources in order of code points, null last, get the weights in turn; targets share the
whole corpus by weight, none above MAX_EPOCHS times its source's size, the excess going to the others by
weight (water filling, in closed form over running sums of the sources). A document is taken
floor(rate) times, and once more with the probability of the rest, by a hash of its id.

Defined cases: a null text has size 0; a source without words has target 0 and its documents a rate of 0;
a null doc_id is hashed as such; more than MAX_SOURCES sources are an error; repeated rows are drawn alike; `mix` keeps extra columns of any name but those
that begin with two underscores, which are kept for the steps inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240
SALTS = 256
MAX_SOURCES = 1 << 20  # rows of the table of sources, which a few windows put in order as a whole
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """Add __size: the words of the text."""
    return docs.withColumn("__size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target of a table with source and __size. One row per source; more than MAX_SOURCES
    fail, since water filling orders all sources at once: name coarser ones then."""
    by = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    by = by.withColumn("__few", F.count("*").over(Window.partitionBy(F.lit(1))) <= MAX_SOURCES)
    by = by.where(F.col("__few") | F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")).cast("boolean"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = by.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    # Sources are capped from the least cap per weight on; the k-th is capped if the level that the others
    # would share, with all before it capped, is above its own.
    level = Window.orderBy((F.col("source_size") * epochs) / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = w.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything), "done": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * epochs, "gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    w = w.withColumn("share", (F.col("total") - F.col("done")) / (F.col("weights") - F.col("gone")).cast("double"))
    w = w.withColumn("capped", F.col("share") * F.col("weight") >= epochs * F.col("source_size"))
    w = w.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("gone"), F.col("share")))).over(everything)["share"])
    return w.select("source", "source_size", F.when(F.col("capped"), (epochs * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _rated(docs: DataFrame, weights, epochs: int, seed: int) -> DataFrame:
    """Add __size, __source_size, __target and __copies."""
    sizes = sized(docs)
    goal = targets(sizes.select("source", "__size"), weights, epochs).select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.coalesce(F.col("__target") / F.nullif(F.col("__source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    draw = bits / F.lit(float(1 << 52))
    # A source may hold a third of all rows: its row of `goal` is repeated over SALTS keys.
    goal = goal.withColumn("__key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sizes = sizes.withColumn("__salt", F.pmod(bits, F.lit(SALTS)).cast("int"))
    joined = sizes.join(goal, (F.col("__salt") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__source"))).withColumn("__rate", rate)
    copies = (F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("int")).cast("long")
    return joined.withColumn("__copies", copies).drop("__source", "__salt", "__key", "__rate")


def rates(docs: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Add size, source_size, target and copies; columns of these names are replaced."""
    added = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return _rated(docs, weights, epochs, seed).select(*kept, *[F.col(f"__{c}").alias(c) for c in added])


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of the input."""
    got = _rated(docs, weights, epochs, seed).where("__copies > 0")
    return got.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of each document."""
    got = rates(docs.select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
