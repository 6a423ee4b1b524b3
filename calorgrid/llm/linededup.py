"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines with a word, without white space at their ends. Lines are deleted that
belong to a run of lines with GUARANTEE words or more which also stands at an earlier place (by doc_id, then hash of
the text, then line), whichever place that is; so the first place of every line stays.

A gram is the shortest run of lines from a line on with GRAM_WORDS words or more; a stretch is the shortest with
GUARANTEE words or more. Of the grams inside a stretch the one with the least hash is its fingerprint, so places
that share a stretch share a fingerprint, at the same line of it. Fingerprints that stand once end there. The others
are joined with their places and extended both ways, to the stretches that chose them and to the shortest runs
of GUARANTEE words that end at a line and begin with such a stretch. For each of these runs the earliest place is
found, and the lines of later places go. That is every line of every repeated run: in a run that two places share,
a line lies in the stretch from the first line, in the shortest run that ends with the last, or before the
latter, and then in the stretch from itself; all of these lie in the run and have a fingerprint in it.

Defined cases: a null or empty text has no lines and stays as it is; lines without a word are no part of a
run and stay; rows that share doc_id and text are one document and keep or lose the same lines; rows that
share only the doc_id come in order of a hash of their texts; null doc_ids come first; other columns are kept,
those named as the added ones are replaced, and no name may begin with two underscores; a text that loses all its lines with words becomes empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from calorgrid.llm import hot, kernel, store

GRAM_WORDS = 8
GUARANTEE = 25  # a single line of as many words is a run, and so is a text
U = np.uint64


def lines(data: np.ndarray, offsets: np.ndarray):
    """Hash, number within the text, words and text of each line with a word."""
    starts, ends, _ = kernel.words(data, offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, z
    breaks = np.flatnonzero(data == 0x0A)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # offsets repeat for empty texts; the last of equal offsets holds the byte
    line = np.searchsorted(breaks, starts)
    head = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(head[1:], len(starts)) - 1
    h = kernel.span_hash(kernel.byte_values(data), starts[head], ends[last])
    return h, line[head] - np.searchsorted(breaks, offsets[doc[head]]), last - head + 1, doc[head]


def runs(h: np.ndarray, n_words: np.ndarray, doc: np.ndarray):
    """Hash, first line and line after the last of the runs of GUARANTEE words, lines numbered over all texts, with the
    hash and the line of the fingerprint of each; in order of the latter."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(n_words)])
    close = np.searchsorted(doc, doc, side="right")  # the line after the text's last
    end = np.searchsorted(total, total[:-1] + GRAM_WORDS)
    gram = np.flatnonzero(end <= close)
    key = np.full(n, U(0xFFFFFFFFFFFFFFFF))
    key[gram] = kernel.span_hash(h, gram, end[gram])
    stretch = np.searchsorted(total, total[:-1] + GUARANTEE)
    i = np.flatnonzero(stretch <= close)
    best, j = i.copy(), i + 1
    on = np.flatnonzero((j < close[i]) & (end[np.minimum(j, n - 1)] <= stretch[i])) if n else i
    while len(on):
        less = key[j[on]] < key[best[on]]
        best[on[less]] = j[on[less]]
        j[on] += 1
        on = on[(j[on] < close[i[on]]) & (end[np.minimum(j[on], n - 1)] <= stretch[i[on]])]
    chosen = np.zeros(n, np.int64)
    chosen[i] = best
    # the latest first line of a run that ends with each line; one that is a stretch is there already
    last = np.arange(n)
    first = np.searchsorted(total, total[1:] - GUARANTEE, side="right") - 1
    back = np.flatnonzero(first >= np.searchsorted(doc, doc))
    back = back[stretch[first[back]] != last[back] + 1]
    start, to = np.concatenate([i, first[back]]), np.concatenate([stretch[i], last[back] + 1])
    order = np.argsort(chosen[start], kind="stable")
    start, to = start[order], to[order]
    return kernel.span_hash(h, start, to), start, to, key[chosen[start]], chosen[start]


def _gram_counts(docs: DataFrame, text: str) -> DataFrame:
    """_gram and n: the fingerprints that stand at several places, and at how many."""

    def run(batches):
        for batch in kernel.slices(batches, "text"):
            h, _, n_words, doc = lines(*kernel.flat(kernel.column(batch, "text")))
            *_, gram, at = runs(h, n_words, doc)
            key, n = np.unique(gram[np.unique(at, return_index=True)[1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["_gram", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "_gram long, n long")
    return found.groupBy("_gram").agg(F.sum("n").alias("n")).where("n > 1")


def _places(docs: DataFrame, text: str) -> DataFrame:
    """_gram, doc_id, _t (hash of the text), at and runs (key, start, end) of each place of a fingerprint."""

    def run(batches):
        for batch in kernel.slices(batches, "text"):
            h, _, n_words, doc = lines(*kernel.flat(kernel.column(batch, "text")))
            key, start, to, gram, at = runs(h, n_words, doc)
            if not len(key):
                continue
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            open_ = np.searchsorted(doc, doc[start])
            each = [pa.array(key.view(np.int64)), pa.array((start - open_).astype(np.int32)), pa.array((to - open_).astype(np.int32))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)), pa.int32()), pa.StructArray.from_arrays(each, names=["key", "start", "end"]))
            rows = pa.array(doc[at[head]])
            columns = [pa.array(gram[head].view(np.int64)), kernel.column(batch, "doc_id").take(rows), kernel.column(batch, "_t").take(rows), pa.array((at - open_)[head].astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["_gram", "doc_id", "_t", "at", "runs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "_gram long, doc_id long, _t long, at int, runs array<struct<key: long, start: int, end: int>>")


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _t (hash of the text) and cuts: stretches [start, end) of lines with words to delete; written."""
    with store.Scratch(docs.sparkSession, "lines") as tables:
        grams = tables.cut(_gram_counts(docs, text), "grams")
        shared = hot.spread_join(_places(docs, text), grams, ["_gram"], "n", "_t")
        found = tables.cut(shared.select("doc_id", "_t", F.explode("runs").alias("run")).select("doc_id", "_t", "run.*"), "runs")
        place = F.struct("doc_id", "_t", "start")
        first = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        first = tables.cut(first.where("first <> last").drop("last"), "first")
        later = hot.spread_join(found, first, ["key"], "n", "_t").where(~place.eqNullSafe(F.col("first")))
        cuts = later.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
        return store.cut(cuts, "cuts")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by what is left of it; add n_lines (with a word) and n_removed. The texts are shuffled
    once, to meet the lines that they lose."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cuts = repeats(docs, text).select(F.col("doc_id").alias("__id"), F.col("_t").alias("__h"), F.col("cuts").alias("__cuts"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = rows.join(cuts.hint("shuffle_hash"), (F.xxhash64(text) == F.col("__h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").drop("__id", "__h")

    def run(batches):
        for batch in kernel.slices(batches, text):
            data, offsets = kernel.flat(kernel.column(batch, text))
            _, number, _, doc = lines(data, offsets)
            n = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            lost = np.zeros(batch.num_rows, np.int64)
            cuts_of = kernel.column(batch, "__cuts")
            texts = kernel.column(batch, text)
            hit = np.flatnonzero(np.asarray(cuts_of.is_valid()))
            if len(hit):
                new = texts.to_pylist()
                for k, cuts in zip(hit.tolist(), cuts_of.take(pa.array(hit)).to_pylist()):
                    gone = np.zeros(n[k], bool)
                    for c in cuts:
                        gone[c["start"] : c["end"]] = True
                    drop = set(number[first[k] : first[k] + n[k]][gone].tolist())
                    new[k] = "\n".join(x for i, x in enumerate(new[k].split("\n")) if i not in drop)
                    if len(drop) == n[k]:
                        new[k] = ""
                    lost[k] = len(drop)
                texts = pa.array(new, pa.string())
            columns = [texts if c == text else kernel.column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(lost)], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, cleaned text, n_lines and n_removed of each document."""
    return dedup(docs.select("doc_id", "text"))
