"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are the n-grams of 1 to ORDERS characters of the lower-cased text, every character that is no letter
being a blank; n-grams of blanks alone don't count. Each is hashed into one of BUCKETS. The matrix of log
probabilities (buckets x languages, at most CELLS) is broadcast: beyond 64 languages neighbouring buckets are
one, so that every language is learned, and beyond MAX_LANGS of them fitting fails; batches are scored in numpy by
summing its rows.

Fitting takes a bounded sample, TRAIN_DOCS documents per language, the least by a hash of their ids; the prior
counts all labelled documents of the training folds.

Defined cases: a text that is null or has no letter (a mark alone is none) is `und` with score 0, as is every
text if there was nothing to learn from; rows labelled `und` say that their language is unknown and are not
learned from; of equally likely languages the first by code points wins; a null doc_id is hashed as an empty text and so is held out;
other columns are kept, columns of the names that are added are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from calorgrid.llm import kernel

ORDERS = 3
BUCKETS = 1 << 17
TRAIN_DOCS = 4000
CELLS = BUCKETS * 64
MAX_LANGS = 8192
FOLDS = 5
SMOOTHING = 0.1
SLICE = 1 << 18  # bytes of text scored at once
U = np.uint64


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case form of each letter and each mark, a blank for other characters; and whether each
    character is a letter."""
    low = np.full(sys.maxunicode + 1, 0x20, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        letter[c] = kind == "L"
        if kind in "LM":
            s = chr(c).lower()
            low[c] = ord(s) if len(s) == 1 else c
    return low, letter


def features(data: np.ndarray, offsets: np.ndarray):
    """For each order the bucket of each n-gram and the text it is of, and which texts have a letter."""
    cps, edge = kernel.code_points(data, offsets)
    low, letter = _letters()
    chars = low[cps].astype(U)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(edge))
    full = chars != 0x20
    lettered = np.zeros(len(offsets) - 1, bool)
    lettered[owner[letter[cps]]] = True
    code, some = chars.copy(), full.copy()
    parts = []
    for n in range(1, ORDERS + 1):
        if n > 1:
            code, some = code[:-1] * U(0x110000) + chars[n - 1 :], some[:-1] | full[n - 1 :]
        if n > len(chars):
            break
        of = owner[: len(code)]
        use = np.flatnonzero(some & (of == owner[n - 1 :]))
        bucket = (kernel.mix(code[use] + U(n) * U(0xA0761D6478BD642F & (1 << 62) - 1)) >> U(64 - 17)).astype(np.int32)
        parts.append((bucket, of[use]))
    return parts, lettered


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.weights, self.prior = langs, weights, prior
        self.shift = BUCKETS.bit_length() - len(weights).bit_length()  # of a bucket, to its row of weights


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from documents outside the held-out fold that have a language."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(~held_out(F.col("_key")) & F.col("_lang").isNotNull() & (F.col("_lang") != "und") & F.col("_text").isNotNull())
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    shift = 0
    while (BUCKETS >> shift) * len(langs) > CELLS:
        shift += 1
    buckets = BUCKETS >> shift
    spark = docs.sparkSession
    part = spark.createDataFrame([(lg, k, min(1.0, train_docs / counts[lg])) for k, lg in enumerate(langs)], "_lang string, _index int, _share double")
    draw = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(part), "_lang").where(draw < F.col("_share")).select("_index", "_text")  # at most MAX_LANGS rows

    def counted(batches):
        total: dict[int, np.ndarray] = {}
        for batch in kernel.slices(batches, "_text", SLICE):
            which = np.asarray(kernel.column(batch, "_index"))
            data, offsets = kernel.flat(kernel.column(batch, "_text"))
            for bucket, of in features(data, offsets)[0]:
                for k in np.unique(which):
                    got = np.bincount(bucket[which[of] == k] >> shift, minlength=buckets)
                    total[k] = total[k] + got if k in total else got
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["k", "bucket", "n"])

    found = sample.mapInArrow(counted, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    n = np.zeros((buckets, len(langs)))
    n[found.column("bucket").to_numpy(), found.column("k").to_numpy()] = found.column("n").to_numpy()
    n += SMOOTHING
    prior = np.log(np.array([counts[lg] for lg in langs], float) / sum(counts.values()))
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32), prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the posterior probability of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CELLS floats
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        m = shared.value
        for batch in kernel.slices(batches, text, SLICE):
            data, offsets = kernel.flat(kernel.column(batch, text))
            n = batch.num_rows
            if m.langs:
                parts, known = features(data, offsets)
                total = np.tile(m.prior, (n, 1))
                for bucket, of in parts:
                    if len(bucket):
                        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        total[of[head]] += np.add.reduceat(m.weights[bucket >> m.shift], head, axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                score = np.where(known, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                name = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            else:
                name, score = ["und"] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
