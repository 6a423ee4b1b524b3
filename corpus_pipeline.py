"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds the sampled pieces.

Defined cases, for all stages: other columns than those of documents, of any name, are dropped; an empty table
gives an empty one; texts are whole however long. Language: null texts and texts without a letter are `und` and
go; a null lang teaches nothing. Lines: an empty text stays as it is. Near duplicates: texts without a word are
linked with nothing and stay; of rows that share id and text one stays; rows that share only the id are told apart
by their texts. Mixing: a null text has no words, a null source is a source of its own, repeated rows are drawn
alike; a source without words is taken not at all. Pieces: a null text gives no pieces and lossless is null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.llm import langid, linededup, mixing, ngramjoin, spsample, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.5
PIECES = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; lang becomes the predicted one."""
    model = langid.fit(docs)
    found = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that stand earlier; documents of which nothing is left go."""
    left = linededup.dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar n-gram sets join, keep the one with the least id, of several with that id
    the one with the least hash of its text. Rows without words are linked with nothing; of rows that share an id
    and a text one stays, and only such ids are shuffled again for it."""
    docs = docs.select(*COLUMNS)
    least = ngramjoin.join(docs, links=False, groups=True).where("doc_id <=> component_id")
    own = F.coalesce("group", "text_hash").alias("_group")
    kept = least.groupBy(F.col("doc_id").alias("_id"), (F.col("n_shingles") > 0).alias("_linked"), own).agg(F.min("text_hash").alias("_hash"), (F.count("*") > 1).alias("_again"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    found = docs.join(kept, same).select(*COLUMNS, "_again")
    once = found.where("not _again").select(*COLUMNS)
    return once.union(found.where("_again").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources come near their target weights."""
    return mixing.mix(docs).select(*COLUMNS)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add a sampled segmentation and whether it decodes to the text."""
    path = public_tokenizers.path(PIECES)
    got = spsample.encode(docs, path, decoded="decoded")
    return got.select(*COLUMNS, "piece_ids", (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("pieces", sample_pieces),
]
#: Hashed n-grams, winnowing and sampled segmentations have no form in SQL; tests/llm holds each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.cut(stage(spark, docs, sf_dir), name)
    return docs
