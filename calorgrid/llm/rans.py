"""Token ids in files coded by a static range asymmetric numeral system.

A file is a group of documents: a table of symbol frequencies, an index of the documents, and blocks that share
the table. A block is coded on its own by up to LANES interleaved 64-bit states that renormalise by 32-bit words;
it keeps the states and the place in the words at every CHECKPOINT-th step and a checksum of the ids from there
to the next, so that any stretch between two checkpoints is decoded and checked alone: `read` deals the stretches
of all files over the tasks. Every frame has a checksum of its bytes.

    frame    kind (4 bytes), bytes of the payload (u64), crc32 of the payload (u32), payload
    TABL     symbols (u32), then their ids (u32) and their frequencies (u32), which add up to 2**BITS
    DOCS     documents (u64), then their ids (i64), 1 where the id is null (u8), tokens of each (u64)
    BLCK     ids (u64), lanes (u32), checkpoints (u32), words (u64), then for each checkpoint its first word
             (u64), the crc32 of the ids from it on (u32) and its states (u64 for each lane), and the words (u32)

All integers are little-endian; a line feed ends a file. A group, and so a file and a writer's memory, has at most
`group_ids` ids or is one document.

Defined cases: a null text is empty and has the end id alone; documents with a null id come first; rows that
share an id are kept, each with its own place; other columns are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from calorgrid.llm import kernel, store, vocab

BITS = 20
LANES = 1024
CHECKPOINT = 256
BLOCK = 1 << 20
GROUP = 1 << 23
END_ID = 0
LOW = np.uint64(1 << 31)
_HEAD = "<QIIQ"
_W, _B, _MASK = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and integer frequencies of at least 1 that add up to 2**BITS."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << BITS:
        raise ValueError("more symbols than the table has room for")
    freq = np.maximum(1, counts.astype(np.int64) * (1 << BITS) // counts.sum())
    left = (1 << BITS) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if left > 0:
        freq[order[0]] += left
    for k in order:  # the largest give what the least have too much
        if left >= 0:
            break
        take = min(-left, int(freq[k]) - 1)
        freq[k] -= take
        left += take
    return symbols.astype("<u4"), freq.astype("<u4")


class Coder:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        """The payload of a BLCK frame."""
        n = len(ids)
        lanes = min(LANES, max(1, n // 16))
        steps = -(-n // lanes)
        rows = np.zeros(steps * lanes, np.int64)
        rows[:n] = np.searchsorted(self.symbols, ids)
        freq, below = self.freq[rows].reshape(steps, lanes), self.below[rows].reshape(steps, lanes)
        x = np.full(lanes, LOW, np.uint64)
        words, total, marks = [], 0, []
        for k in range(steps - 1, -1, -1):
            f = freq[k]
            full = (x >> np.uint64(63 - BITS)) >= f
            if full.any():
                out = x[full]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                total += len(out)
                x[full] = out >> _W
            q = x // f
            x = (q << _B) + (x - q * f) + below[k]
            if k % CHECKPOINT == 0:
                marks.append((total, x.copy()))
        marks.reverse()
        raw, size = ids.astype("<u4").tobytes(), 4 * CHECKPOINT * lanes
        crc = np.array([zlib.crc32(raw[k * size : (k + 1) * size]) for k in range(len(marks))], "<u4")
        at = np.array([total - t for t, _ in marks], "<u8")
        head = struct.pack(_HEAD, n, lanes, len(marks), total)
        return b"".join([head, at.tobytes(), crc.tobytes(), *(x.astype("<u8").tobytes() for _, x in marks), *(w.tobytes() for w in reversed(words))])

    def decode(self, piece: Stretch) -> np.ndarray:
        """The ids of a stretch."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.symbols)), self.freq.astype(np.int64))
        x = np.frombuffer(piece.states, "<u8").astype(np.uint64)
        words, w, lanes = np.frombuffer(piece.words, "<u4").astype(np.uint64), 0, len(x)
        got = np.empty((-(-piece.n // lanes), lanes), np.int64)
        for k in range(len(got)):
            slot = x & _MASK
            s = self.slots[slot.astype(np.int64)]
            got[k] = s
            x = self.freq[s] * (x >> _B) + slot - self.below[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << _W) | words[w : w + len(low)]
                w += len(low)
        ids = self.symbols[got.reshape(-1)[: piece.n]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != piece.crc:
            raise ValueError("the ids of a stretch don't match their checksum")
        return ids


class Stretch(NamedTuple):
    """What a block holds from one checkpoint to the next."""

    first: int  # its first id within the block
    n: int
    crc: int
    states: bytes
    words: bytes


def stretches(payload: bytes) -> Iterator[Stretch]:
    """The stretches of a BLCK frame, without decoding them."""
    n, lanes, marks, total = struct.unpack_from(_HEAD, payload)
    at = struct.calcsize(_HEAD)
    places = [*np.frombuffer(payload, "<u8", marks, at).tolist(), total]
    crc = np.frombuffer(payload, "<u4", marks, at + 8 * marks).tolist()
    states, words = at + 12 * marks, at + 12 * marks + 8 * marks * lanes
    for k in range(marks):
        first = k * CHECKPOINT * lanes
        yield Stretch(first, min(n - first, CHECKPOINT * lanes), crc[k], bytes(payload[states + 8 * lanes * k : states + 8 * lanes * (k + 1)]), bytes(payload[words + 4 * places[k] : words + 4 * places[k + 1]]))


def frame(kind: bytes, payload: bytes) -> bytes:
    return struct.pack("<4sQI", kind, len(payload), zlib.crc32(payload)) + payload


def frames(content: bytes):
    at, whole = 0, memoryview(content)
    while at < len(content):
        kind, n, crc = struct.unpack_from("<4sQI", content, at)
        payload = whole[at + 16 : at + 16 + n]
        if zlib.crc32(payload) != crc:
            raise ValueError("a frame doesn't match its checksum")
        yield kind, payload
        at += 16 + n
        if whole[at : at + 1] == b"\n":
            at += 1


def group(keys: list, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK):
    """The frames of some whole documents."""
    symbols, freq = frequencies(ids)
    yield frame(b"TABL", struct.pack("<I", len(symbols)) + symbols.tobytes() + freq.tobytes())
    null = np.array([k is None for k in keys], np.uint8)
    yield frame(b"DOCS", struct.pack("<Q", len(keys)) + np.array([k or 0 for k in keys], "<i8").tobytes() + null.tobytes() + counts.astype("<u8").tobytes())
    coder = Coder(symbols, freq)
    for at in range(0, len(ids), block):
        yield frame(b"BLCK", coder.encode(ids[at : at + block]))


def table(payload: bytes) -> Coder:
    (n,) = struct.unpack_from("<I", payload)
    return Coder(np.frombuffer(payload, "<u4", n, 4), np.frombuffer(payload, "<u4", n, 4 + 4 * n))


def index(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, and tokens of the documents of a DOCS frame."""
    (n,) = struct.unpack_from("<Q", payload)
    return np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, np.uint8, n, 8 + 8 * n) > 0, np.frombuffer(payload, "<u8", n, 8 + 9 * n).astype(np.int64)


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, group_ids: int = GROUP, block: int = BLOCK) -> None:
    """Encode texts and write their ids, documents in ascending order of their key over the files' names.

    One shuffle of the texts, by ranges of the key; hashes of the texts split a key that many rows share.
    """

    def encode(batches):
        bpe = vocab.load(vocabulary)
        keys, counts, parts, held = [], [], [], 0

        def flush():
            content = b"".join(group(keys, np.concatenate(counts), np.concatenate(parts), block))
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in kernel.slices(batches, text):
            data, offsets = kernel.flat(kernel.column(batch, text))
            ids, first = bpe.encode(data, offsets)
            n = first[1:] - first[:-1] + 1
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            inside = np.ones(len(out), bool)
            inside[np.cumsum(n) - 1] = False
            out[inside] = ids
            if held and held + len(out) > group_ids:
                yield from flush()
                keys, counts, parts, held = [], [], [], 0
            keys += kernel.column(batch, key).to_pylist()
            counts.append(n)
            parts.append(out)
            held += len(out)
        if held:
            yield from flush()

    rows = docs.select(F.col(key).cast("long").alias(key), text)
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    blobs = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, "content binary")
    store.write_blobs(blobs, "content", path, "\n", rows_per_file=1)


UNIT = "part string, base long, first long, n long, crc long, states binary, words binary, codes binary, place long, docs binary"
_UNIT = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
_UNIT_NAMES = [c.split()[0] for c in UNIT.split(", ")]
PIECE = "part string, place long, local_start long, key long, n_tokens long, at long, n long, crc long, ids binary"

_PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_DOCUMENT = [("part", pa.string()), *((c, pa.int64()) for c in ("place", "local_start", "key", "n_tokens", "ids_crc32")), ("ids", pa.binary())]


def units(spark: SparkSession, path: str) -> DataFrame:
    """One row per stretch: what its decoding needs, and the documents (place of the first, then key, whether it is
    null, start and end within the file of each) that it has ids of."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, base, rows = b"", 0, []
                for kind, payload in frames(content.as_py()):
                    if kind == b"TABL":
                        codes = bytes(payload)
                    elif kind == b"DOCS":
                        keys, null, counts = index(payload)
                        ends = np.cumsum(counts)
                    else:
                        for s in stretches(payload):
                            a, b = base + s.first, base + s.first + s.n
                            i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right") + 1
                            docs = np.stack([keys[i:j], null[i:j], ends[i:j] - counts[i:j], ends[i:j]], 1).astype("<i8").tobytes()
                            rows.append((name, base, s.first, s.n, s.crc, s.states, s.words, codes, int(i), docs))
                        base += s.first + s.n
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, _UNIT)], names=_UNIT_NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, UNIT)


def combine(crc: int, other: int, n: int) -> int:
    """The crc32 of two byte strings in a row, from their checksums and the length of the second."""

    def times(m, v):
        out = 0
        while v:
            low = v & -v
            out ^= m[low.bit_length() - 1]
            v ^= low
        return out

    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = [times(m, v) for v in m]
    while n:
        if n & 1:
            crc = times(m, crc)
        m, n = [times(m, v) for v in m], n >> 1
    return crc ^ other


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """part, place (order in the file), local_start, key, n_tokens, ids_crc32 and, if asked for, ids (binary,
    little-endian u32) of each document. Stretches are dealt over all tasks, whatever file they are of; the pieces
    of documents that lie in several meet by document, of which there are few."""

    def decode(batches):
        codes, coder = None, None
        for batch in batches:
            for u in batch.to_pylist():
                if u["codes"] != codes:
                    codes, coder = u["codes"], table(u["codes"])
                raw = coder.decode(Stretch(u["first"], u["n"], u["crc"], u["states"], u["words"])).tobytes()
                a = u["base"] + u["first"]
                key, null, start, end = np.frombuffer(u["docs"], "<i8").reshape(-1, 4).T
                low, high = np.maximum(start, a), np.minimum(end, a + u["n"])
                spans = [raw[4 * x : 4 * y] for x, y in zip((low - a).tolist(), (high - a).tolist())]
                columns = [pa.array([u["part"]] * len(key), pa.string()), pa.array(np.arange(len(key)) + u["place"]), pa.array(start), pa.array(key, mask=null > 0), pa.array(end - start), pa.array(low - start), pa.array(high - low), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(spans if ids else [None] * len(key), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=_PIECE_NAMES)

    def join(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:  # a document has one piece, a long one a few
                r["ids_crc32"] = r["pieces"][0]["crc"]
                for p in r["pieces"][1:]:
                    r["ids_crc32"] = combine(r["ids_crc32"], p["crc"], 4 * p["n"])
                if ids:
                    r["ids"] = b"".join(p["ids"] for p in r["pieces"])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_DOCUMENT if ids else _DOCUMENT[:-1]))

    document = ["part", "place", "local_start", "key", "n_tokens"]
    schema = "part string, place long, local_start long, key long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    pieces = units(spark, path).repartition("part", "base", "first").mapInArrow(decode, PIECE)
    parts = pieces.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "ids"))).alias("pieces"))
    return parts.mapInArrow(join, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before, from one total per file. `rows` is scanned twice."""
    number = lambda of: F.regexp_extract("part", of, 1).cast("long")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(number(r"part-(\d+)"), number(r"-c(\d+)"), "part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(files.select("part", F.coalesce(before, F.lit(0)).alias("_before")), "part").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    path = store.new_path(spark, "rans")
    write(docs, path, vocabulary)
    rows = store.cut(read(spark, path, ids=False), "rans-index")
    return with_starts(rows).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
