"""Document fingerprints by Order MinHash over character k-mers.

The k-mers of a text are numbered by occurrence. For each of SKETCHES hash functions the TUPLE least numbered
k-mers are selected and put back into the order they have in the text; the hash of that tuple of k-mers is
one component of the signature. Two texts agree on a component if they share the selected k-mers in the same
order, so moving text about costs likeness as well as changing it.

Defined cases: a null text is empty; a text shorter than K is one k-mer; an empty text has the signature of
zeros and is like other empty texts only; rows are put in order by descending doc_id, null last, then by a
hash of the text; in a table of one row the next document is the row itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.llm import kernel, store

K = 12
SKETCHES = 64
TUPLE = 2
BLOCK = 2048
U = np.uint64
_SALT = kernel.mix(np.arange(1, SKETCHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))[:, None]
_ODD = kernel.mix(np.arange(1001, SKETCHES + 1001, dtype=U) * U(0x9E3779B97F4A7C15))[:, None] | U(1)
_TOP = U(0xFFFFFFFFFFFFFFFF)


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of the k-mers in order."""
    values = kernel.mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U) + U(1))
    n = len(values)
    if n <= k:
        return kernel.span_hash(values, np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n, np.int64))
    up, down = kernel.powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return kernel.mix((total[k:] - total[:-k]) * down[: n - k + 1])


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence: the first keeps its hash, later ones get another."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return h
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    of = np.flatnonzero(twice[at] == h)
    of = of[np.argsort(h[of], kind="stable")]
    g = h[of]
    head = np.append(True, g[1:] != g[:-1])
    place = np.arange(len(of))
    nth = place - np.maximum.accumulate(np.where(head, place, 0))
    out = h.copy()
    later = nth > 0
    out[of[later]] = kernel.mix(g[later] + nth[later].astype(U) * U(0xD1342543DE82EF95))
    return out


def signature(text: str) -> np.ndarray:
    """SKETCHES 16-bit components."""
    h = kmers(text)
    n = len(h)
    if not n:
        return np.zeros(SKETCHES, np.uint16)
    h2 = numbered(h)
    rows = np.arange(SKETCHES)
    keys, places = [], []
    for a in range(0, n, BLOCK):  # the least of each block, then the least of those
        v = (h2[None, a : a + BLOCK] ^ _SALT) * _ODD
        for _ in range(min(TUPLE, v.shape[1])):
            p = v.argmin(axis=1)
            keys.append(v[rows, p])
            places.append(p + a)
            v[rows, p] = _TOP
    keys, places = np.stack(keys, 1), np.stack(places, 1)
    if keys.shape[1] > TUPLE:
        best = np.argpartition(keys, TUPLE - 1, axis=1)[:, :TUPLE]
        places = np.take_along_axis(places, best, 1)
    places.sort(axis=1)
    out = np.zeros(SKETCHES, U)
    for j in range(places.shape[1]):
        out = kernel.mix(out * U(0x9E3779B97F4A7C15) + h[places[:, j]] + U(j + 1))
    return np.maximum(out >> U(48), U(1)).astype(np.uint16)


def fingerprint(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float((a == b).mean())


_COLUMNS = [("kind", pa.string()), ("part", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'binary' if t == pa.binary() else 'double' if t == pa.float64() else 'long'}" for n, t in _COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], names=[n for n, _ in _COLUMNS])


def compare(part: int, key, text: str, sig: np.ndarray, after: str, after_sig: np.ndarray) -> tuple:
    """The row of a document whose next is known."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    of_edited = signature(edited)
    return ("done", part, key, None, len(text), hashlib.sha256(edited.encode()).digest(), fingerprint(sig), fingerprint(of_edited), likeness(sig, of_edited), likeness(sig, after_sig))


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its text edited by the next document's, and their likeness.

    One shuffle of the texts, by ranges of doc_id. Within a range each document meets the next; of each range
    the first and the last document are kept aside with their texts and are matched in a second, small job.
    """

    def ranges(batches):
        from pyspark import TaskContext

        part, before, rows, size = TaskContext.get().partitionId(), None, [], 0
        for batch in kernel.slices(batches, "text"):
            for key, text in zip(kernel.column(batch, "doc_id").to_pylist(), kernel.column(batch, "text").to_pylist()):
                text = text or ""
                sig = signature(text)
                if before is None:
                    rows.append(("first", part, key, text, None, None, None, None, None, None))
                else:
                    rows.append(compare(part, *before, text, sig))
                before = (key, text, sig)
            yield _batch(rows)
            rows = []
        if before is not None:
            yield _batch([("last", part, before[0], before[1], None, None, None, None, None, None)])

    def edges(batches):
        for batch in batches:
            for r in batch.to_pylist():
                text, after = r["text"] or "", r["after"] or ""
                yield _batch([compare(r["part"], r["doc_id"], text, signature(text), after, signature(after))])

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = store.cut(rows.mapInArrow(ranges, _SCHEMA), "fingerprints")
    firsts, lasts = rows.where("kind = 'first'").select("part", F.col("text").alias("after")), rows.where("kind = 'last'").select("part", "doc_id", "text")
    numbers = firsts.select("part")  # one for each range
    following = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("_next"))
    pairs = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "_next"), "_next").select("part", "doc_id", "text", "after")
    done = rows.where("kind = 'done'").union(pairs.mapInArrow(edges, _SCHEMA))
    as_hex = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return done.select("doc_id", "n_chars", *as_hex, "near_edited", "near_next")
