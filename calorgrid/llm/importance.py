"""Importance resampling towards a target distribution over hashed word n-grams, by an integer word dictionary.

Texts are read in slices. A slice knows its distinct words and its distinct n-grams as tuples of word numbers, and
is written once: words, tuples, and for each document the numbers of its tuples with their counts. Distinct words
of all slices form the dictionary, which gives each an integer. A slice's tuples become tuples of dictionary ids;
equal ones of all slices are counted together, their bytes are put together from the dictionary and hashed once,
and the gains of their buckets go back to the slices that have them, and from there to the documents.

A word or tuple has one row per slice, however often the slice has it, so no key is hot: the commonest word has as
many rows as there are slices. Only the `buckets` gains, a parameter, are broadcast. Ranks come from a range
partitioning, the sizes of whose parts (one number each) are summed on the driver.

Defined cases: a null or empty text has no features, weight 0 and a score; a null doc_id is hashed as `null` and
comes first among equal scores; repeated rows get ranks of their own, those of one id in order of their places;
an empty target gives every bucket the gain of no occurrence; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from calorgrid.llm import kernel, store

BUCKETS = 10000
LONGEST = 1  # words of an n-gram
MIN_WORDS = 20
DRAW_PERCENT = 10
SEED = 2024
SLICE = 1 << 22
GROUP = 1  # slices that a reader takes at once
HELD = 1 << 20  # gains that a task holds before it sends them to their slices
SLICES = """slice long, target boolean, words array<binary>, grams array<int>, starts array<int>, sizes array<int>, counts array<long>,
  doc_ids array<long>, n_words array<long>, ends array<long>, doc_grams array<int>, doc_counts array<int>"""


def grams(codes: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to `longest` words within texts, as the concatenated numbers of their words and their
    sizes; and of all n-grams the number and the text."""
    n = np.diff(first)
    flat, sizes, number, owner, base = [], [], [], [], 0
    same = np.zeros(len(codes), np.int64)  # the number of the n-gram that starts at each word, by its first words
    for size in range(1, longest + 1):
        count = np.maximum(n - size + 1, 0)
        at = kernel.ragged(first[:-1], count)
        key = same[at] * (codes.max(initial=0) + 1) + codes[at + size - 1]
        _, head, back = np.unique(key, return_index=True, return_inverse=True)
        start = at[head]
        flat.append(codes[start[:, None] + np.arange(size)].ravel())
        sizes.append(np.full(len(head), size, np.int32))
        number.append(back + base)
        owner.append(np.repeat(np.arange(len(n)), count))
        base += len(head)
        same = np.zeros(len(codes), np.int64)
        same[at] = back
    return np.concatenate(flat), np.concatenate(sizes), np.concatenate(number), np.concatenate(owner)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _slices(docs: DataFrame, target: bool, longest: int) -> DataFrame:
    """One row per slice, as in SLICES. Slices are numbered by task, so the rows have to be written once."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in kernel.slices(batches, "text", SLICE):
            codes, words, first = kernel.letter_words(*kernel.flat(kernel.column(batch, "text")))
            flat, sizes, number, owner = grams(codes, first, longest)
            pairs, count = np.unique(owner * max(len(sizes), 1) + number, return_counts=True)
            of, gram = np.divmod(pairs, max(len(sizes), 1))
            ends = np.searchsorted(of, np.arange(batch.num_rows), side="right")
            tuples = [flat.astype(np.int32), (np.cumsum(sizes) - sizes).astype(np.int32), sizes]
            if longest == 1:  # the n-grams are the words by their numbers, which need not be written
                tuples = [c[:0] for c in tuples]
            columns = [*tuples, np.bincount(number, minlength=len(sizes)), None, np.diff(first), ends, gram.astype(np.int32), count.astype(np.int32)]
            lists = [words.cast(pa.binary()), *(kernel.column(batch, "doc_id").cast(pa.int64()) if c is None else c for c in columns)]
            row = [_lists(np.array([0, len(c)]), c) for c in lists]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([target]), *row], names=[c.split()[0] for c in SLICES.split(",")])
            k += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SLICES)


def dictionary(slices: DataFrame, buckets: int) -> DataFrame:
    """word, id and bucket: an integer for each distinct word, which is hashed once as the n-gram that it is by
    itself; written so that it stays."""
    words = slices.select(F.explode("words").alias("word")).distinct()
    return store.cut(words.select("word", F.monotonically_increasing_id().alias("id"), _bucket(F.col("word"), buckets)), "dictionary")


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(text), F.lit(buckets)).cast("int").alias("bucket")


def _tuples(slices: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """slice, target, gram (its number in the slice), count and w0, w1, ...: ids of the words, null after its last. Single
    words are the dictionary's entries and have their bucket from it."""
    if longest == 1:
        each = slices.select("slice", "target", F.posexplode(F.arrays_zip("words", "counts")).alias("gram", "g"))
        return each.join(words, F.col("g.words") == F.col("word")).select("slice", "target", "gram", F.col("g.counts").alias("count"), F.col("id").alias("w0"), "bucket")
    ids = slices.select("slice", F.posexplode("words").alias("at", "word")).join(words, "word")
    ids = ids.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    own = slices.select("slice", "target", "grams", "starts", "sizes", "counts").join(ids, "slice")
    each = own.select("slice", "target", "grams", "ids", F.posexplode(F.arrays_zip("starts", "sizes", "counts")).alias("gram", "g"))

    def word(k: int) -> Column:
        at = F.get("grams", F.col("g.starts") + k)
        return F.when(F.col("g.sizes") > k, F.get("ids", at)).alias(f"w{k}")

    return each.select("slice", "target", "gram", F.col("g.counts").alias("count"), *[word(k) for k in range(longest)])


def _joined(a: DataFrame, b: DataFrame, longest: int) -> DataFrame:
    """Rows of two tables that have one tuple; the first id is never null."""
    b = b.withColumnsRenamed({f"w{k}": f"v{k}" for k in range(longest)})
    on = a["w0"] == b["v0"]
    for k in range(1, longest):
        on = on & a[f"w{k}"].eqNullSafe(b[f"v{k}"])
    return a.join(b, on).drop(*[f"v{k}" for k in range(longest)])


def _counted(uses: DataFrame, *keys: str) -> DataFrame:
    """keys, s and t: how often documents and target have them."""
    count = F.when(F.col("target"), F.lit(0)).otherwise(F.col("count")), F.when(F.col("target"), F.col("count")).otherwise(F.lit(0))
    return uses.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(n) for c, n in zip(count, "st")])


def hashed(uses: DataFrame, words: DataFrame, longest: int, buckets: int) -> DataFrame:
    """w0, w1, ..., bucket, s and t: each distinct tuple, hashed once, and how often documents and target have it."""
    keys = [f"w{k}" for k in range(longest)]
    found = _counted(uses, *keys)
    for k in range(longest):
        named = words.select(F.col("word").alias(f"b{k}"), F.col("id").alias(f"i{k}"))
        found = found.join(named, F.col(f"w{k}") == F.col(f"i{k}"), "inner" if k == 0 else "left").drop(f"i{k}")
    text = F.col("b0")
    for k in range(1, longest):
        text = F.when(F.col(f"b{k}").isNull(), text).otherwise(F.concat(text, F.lit(b" "), F.col(f"b{k}")))
    return found.select(*keys, _bucket(text, buckets), "s", "t")


def gains(tuples: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain, at most `buckets` rows: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    by = tuples.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = by.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(total["s"] + buckets)) / ((F.col("s") + 1) * F.lit(total["t"] + buckets))
    return by.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def _gathered(batches):
    """slice and lists of gram and gain: the gains of a slice that a task has, HELD rows at a time, in one row, as
    rows of their own take more when shuffled."""
    held, n = [], 0

    def rows():
        of, gram, gain = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((gram, of))
        of, gram, gain = of[order], gram[order], gain[order]
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ends = np.append(head, len(of)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in (gram.astype(np.int32), gain.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(of[head]), *lists], names=["slice", "gram", "gain"])

    for batch in batches:
        held.append([np.asarray(kernel.column(batch, c)) for c in ("slice", "gram", "gain")])
        n += batch.num_rows
        if n >= HELD:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def _weights(slices: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, slice, place, n_words, n_features and weight of each document: values has slice, gram and gain, a row for
    each of a slice's n-grams. A slice meets its gains in one group, so a task holds those of one slice at a time."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a slice of the target
            return pa.Table.from_arrays([pa.array([], t) for t in [pa.int64()] * 6], names=["doc_id", "slice", "place", "n_words", "n_features", "weight"])
        row = {c: left.column(c).chunk(0)[0].values for c in left.schema.names if c != "slice"}
        count, gram = np.asarray(row["doc_counts"]).astype(np.int64), np.asarray(row["doc_grams"])
        flat = [pa.concat_arrays([x.flatten() for x in right.column(c).chunks]) for c in ("gram", "gain")] if right.num_rows else [np.zeros(0, np.int32)] * 2
        at, value = (np.asarray(x) for x in flat)
        gain = np.zeros(len(at), np.int64)
        gain[at] = value
        first = np.concatenate([[0], np.asarray(row["ends"])])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (count, count * gain[gram])]
        n, weight = (x[first[1:]] - x[first[:-1]] for x in sums)
        ids = row["doc_ids"]
        return pa.Table.from_arrays([ids, pa.array(np.full(len(ids), key[0].as_py())), pa.array(np.arange(len(ids))), row["n_words"], pa.array(n), pa.array(weight)], names=["doc_id", "slice", "place", "n_words", "n_features", "weight"])

    rows = slices.where("not target").select("slice", "doc_ids", "n_words", "ends", "doc_grams", "doc_counts")
    # a gain is far below 2^31
    lists = values.select("slice", "gram", F.col("gain").cast("int").alias("gain")).mapInArrow(_gathered, "slice long, gram array<int>, gain array<int>")
    both = rows.groupBy("slice").cogroup(lists.groupBy("slice"))
    return both.applyInArrow(run, "doc_id long, slice long, place long, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, slice and place (which tell rows apart), n_words, n_features and weight of each row of docs."""
    texts = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    slices = store.cut(_slices(docs, False, longest).union(_slices(texts, True, longest)), "slices", GROUP)
    words = dictionary(slices, buckets)
    uses = store.cut(_tuples(slices, words, longest), "uses")
    own = uses.where("not target").drop("target", "count")
    if longest == 1:
        back = own.join(F.broadcast(gains(_counted(uses, "bucket"), buckets)), "bucket")
    else:
        tuples = store.cut(hashed(uses, words, longest, buckets), "tuples")
        back = _joined(own, tuples.join(F.broadcast(gains(tuples, buckets)), "bucket").drop("bucket", "s", "t"), longest)
    return _weights(slices, back)


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Add score: the weight and a Gumbel draw by a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return rows.withColumn("score", F.col("weight") + F.floor(F.log(-F.log(u)) * -1000))


def ranked(rows: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add rank to the highest scores: of rows with enough words `percent` in a hundred, ties by doc_id, then place."""
    rows = store.cut(rows, "scores")
    enough = F.col("n_words") >= min_words
    draw = percent * rows.where(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("slice"), F.asc("place")]
    # the parts follow each other in order; a row's rank is its place in its part and the rows of the parts before
    parts = rows.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = store.cut(parts, "ranks")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row per partition
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    offsets = F.broadcast(rows.sparkSession.createDataFrame([(r["_part"], b) for r, b in zip(sizes, before)], "_part int, _before long"))
    rank = F.col("_before") + F.col("_row") + 1
    found = parts.join(offsets, "_part").withColumn("rank", F.when(rank <= draw, rank)).drop("_part", "_row", "_before")
    return found.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document."""
    return ranked(scored(weights(docs, target))).select("doc_id", "n_features", "weight", "score", "rank")
