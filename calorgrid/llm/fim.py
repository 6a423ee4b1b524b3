"""Fill-in-the-middle documents over an index of distinct texts.

Identical texts are one entry of the index: rows meet by a hash of the text and are grouped by the text itself, so
the contents are compared. Each entry has its boundary list, the byte at which every code point begins, as an
Elias-Fano list that is made once per text. Documents go to the index without their texts, by hash, length and a
second hash; each reads the two boundaries of its seeded cut from the list and is put together from bytes.

The texts are shuffled once, the documents as a few numbers each. Texts whose copies would make a large group are
counted first (at most MAX_HOT of them, those with the most bytes); their index is made by itself after partial
aggregation, and their documents are dealt over several places.

Defined cases: a null text is empty and comes back as plain; a null doc_id is hashed as `null`; repeated rows are
cut alike; rows that share only the doc_id are cut by the same hashes, each in its text; other columns are kept,
those named as the added ones are replaced, and no name may begin with two underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from calorgrid.llm import kernel, store

SEED = 1
PLAIN_PERCENT = 10  # documents that stay as they are
SPM_PERCENT = 20  # of the others, those with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HOT_ROWS = 4096  # copies of a text from which its documents are spread
HOT_BYTES = 1 << 25  # of all copies of a text
MAX_HOT = 1 << 16
MAX_PLACES = 1 << 16
_KEYS = ("__h", "__size", "__again")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
# [byte, k]: place of the k-th set bit, from the highest on
_PLACE = np.array([([i for i in range(8) if b >> (7 - i) & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def boundaries(data: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Code points of a text, low bits of each element, packed low bits and the unary high part of the Elias-Fano
    list of the bytes at which its code points begin and of its end."""
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    width = max(0, ((len(data) + 1) // len(at)).bit_length() - 1)
    high = np.zeros((len(data) >> width) + len(at) + 1, np.uint8)
    high[(at >> width) + np.arange(len(at))] = 1
    low = (at[:, None] >> np.arange(width)) & 1
    return len(at) - 1, width, np.packbits(low.astype(np.uint8).ravel()).tobytes(), np.packbits(high).tobytes()


def select(width: np.ndarray, low: pa.Array, high: pa.Array, k: np.ndarray) -> np.ndarray:
    """The k-th element of each row's Elias-Fano list."""
    bits, offsets = kernel.flat(high)
    ones = np.concatenate([[0], np.cumsum(_ONES[bits])])
    rank = ones[offsets[:-1]] + k
    byte = np.searchsorted(ones, rank, side="right") - 1
    place = 8 * (byte - offsets[:-1]) + _PLACE[bits[byte], rank - ones[byte]]
    value = (place - k) << width
    bits, offsets = kernel.flat(low)
    for j in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > j)
        p = k[has] * width[has] + j
        value[has] |= (bits[offsets[:-1][has] + (p >> 3)].astype(np.int64) >> (7 - (p & 7)) & 1) << j
    return value


@F.arrow_udf(T.StructType().add("n", T.LongType()).add("width", T.IntegerType()).add("low", T.BinaryType()).add("high", T.BinaryType()))
def _list(texts: pa.Array) -> pa.Array:
    data, offsets = kernel.flat(texts)
    got = [boundaries(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got), kinds)], names=["n", "width", "low", "high"])


@F.arrow_udf(T.StructType().add("a", T.LongType()).add("b", T.LongType()))
def _bytes_at(width: pa.Array, low: pa.Array, high: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    w = np.asarray(width).astype(np.int64)
    ends = [pa.array(select(w, low, high, np.asarray(k).astype(np.int64))) for k in (a, b)]
    return pa.StructArray.from_arrays(ends, names=["a", "b"])


def _keys(text: str) -> dict[str, Column]:
    """The hash by which copies of a text meet, and what tells texts of one hash apart, length and a second hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"__h": F.xxhash64(t), "__size": F.octet_length(t), "__again": F.xxhash64(F.lit(SEED), t)}


def large_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """__h and __places of the texts whose copies are spread, at most MAX_HOT rows, written."""
    key = _keys(text)["__h"].alias("__h")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size")
    groups = docs.select(key, size).groupBy("__h").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    groups = groups.where((F.col("n") > HOT_ROWS) | ((F.col("n") > 1) & (F.col("size") > HOT_BYTES)))
    places = F.greatest(F.ceil(F.col("n") / HOT_ROWS), F.ceil(F.col("size") / HOT_BYTES))
    top = groups.orderBy(F.desc("size"), F.desc("n"), "__h").limit(MAX_HOT)
    return store.cut(top.select("__h", F.least(places, F.lit(MAX_PLACES)).cast("int").alias("__places")), "copies")


def _same_text() -> Column:
    """Whether a document and an entry with its hash have one text, by length and a second hash. As differences, so
    that the join's keys stay what the texts are dealt by already."""
    size, again = F.octet_length("__text"), F.xxhash64(F.lit(SEED), "__text")
    return (F.col("__size") - size == 0) & (F.col("__again").bitwiseXOR(again) == 0)


def index(docs: DataFrame, hot: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts by __key: those of `hot` with their lists, one row per place (__place), and the others."""
    rows = docs.select(_keys(text)["__h"].alias("__h"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    few = rows.join(F.broadcast(hot.select("__h")), "__h", "left_anti").repartition("__h")
    many = rows.join(F.broadcast(hot.select("__h")), "__h", "left_semi").groupBy("__h", "__text").agg(F.count("*").alias("__n"))
    every = F.explode(F.sequence(F.lit(0), F.col("__places") - 1)).alias("__place")
    lists = many.select(F.col("__h").alias("__key"), "__text", _list("__text").alias("__list"))
    spread = lists.join(F.broadcast(hot), F.col("__key") == F.col("__h")).select("__key", "__text", "__list", every)
    return spread, few.groupBy("__h", "__text").agg(F.count("*").alias("__n")).select(F.col("__h").alias("__key"), "__text")


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4, of the first 32 hexadecimal digits of a SHA-256."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """The columns of docs with n (code points of the text), form (plain, psm or spm), prefix_chars, middle_chars and
    output; the text is that of the index, empty instead of null."""
    kept = [c for c in docs.columns if c not in ADDED]
    hot = large_groups(docs, text)
    spread, rest = index(docs, hot, text)
    small = docs.select(*[F.col(f"`{c}`") for c in kept if c != text], *[c.alias(k) for k, c in _keys(text).items()])
    # The documents of a text come as one row, so that its list is made once and after the join, which needs the texts
    # no second time; they are the small side: a task's texts are neither sorted nor gathered.
    few = small.join(F.broadcast(hot.select("__h")), "__h", "left_anti").repartition("__h").groupBy("__h", "__size", "__again")
    few = few.agg(F.collect_list(F.struct(*[c for c in small.columns if c not in _KEYS])).alias("__docs")).hint("shuffle_hash")
    few = few.join(rest, (F.col("__h") == F.col("__key")) & _same_text()).select("__docs", "__text", _list("__text").alias("__list"))
    few = few.select(F.explode("__docs").alias("__doc"), "__text", "__list").select("__doc.*", "__text", "__list")
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept if c != text]), F.col("__places")).cast("int")
    many = small.join(F.broadcast(hot), "__h").withColumn("__at", place).drop("__places")
    many = many.hint("shuffle_hash").join(spread, (F.col("__h") == F.col("__key")) & (F.col("__at") == F.col("__place")) & _same_text())
    found = few.unionByName(many.drop(*_KEYS, "__key", "__at", "__place"))

    n = F.col("__list")["n"]
    h = _draws(F.col("doc_id"), seed)
    found = found.withColumns({"__x": F.pmod(h[0], n + 1), "__y": F.pmod(h[1], n + 1)})
    marked = F.greatest(*[F.contains("__text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (n == 0) | marked | (F.pmod(h[2], F.lit(100)) >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < SPM_PERCENT, "spm").otherwise("psm")
    found = found.withColumns({"__a": F.least("__x", "__y"), "__b": F.greatest("__x", "__y"), "__form": form})
    found = found.withColumn("__at", _bytes_at("__list.width", "__list.low", "__list.high", "__a", "__b"))
    body, a, b = F.encode("__text", "utf-8"), F.col("__at.a").cast("int"), F.col("__at.b").cast("int")
    size = F.octet_length("__text")
    pre, mid, suf = (F.substring(body, s + 1, e - s).cast("string") for s, e in ((F.lit(0), a), (a, b), (b, size)))
    output = F.when(F.col("__form") == "plain", F.col("__text")).when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), pre, F.lit(SUFFIX), suf, F.lit(MIDDLE), mid)).otherwise(F.concat(F.lit(SUFFIX), suf, F.lit(PREFIX), pre, F.lit(MIDDLE), mid))
    cut = F.col("__form") != "plain"
    columns = [F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in kept]
    return found.select(*columns, n.alias("n"), F.col("__form").alias("form"), F.when(cut, F.col("__a")).alias("prefix_chars"), F.when(cut, F.col("__b") - F.col("__a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: what stands between the marks, which no cut text contains."""

    def parts(first: str, second: str) -> list[Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return [one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))]

    pre, suf, mid = parts(PREFIX, SUFFIX)
    suf2, pre2, mid2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text rebuilt from it."""
    got = transform(docs.select("doc_id", "text"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
