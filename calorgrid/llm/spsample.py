"""Sampled SentencePiece segmentations, by forward filtering and backward sampling over the piece lattice.

The lattice of a text has a node between code points and an edge for each piece; a segmentation has the
probability proportional to exp(theta * sum of its pieces' scores). No usable piece holds a space after its
first place, so all paths meet before every space and the lattice falls into chunks, one for each word; the
forward sums of a chunk are computed once and kept. Backward sampling then runs for all chunks of a slice at
once; its draws are hashes of seed, row key and place in the text, so that a row's segmentation depends on
nothing else.

Texts are taken as the model takes them: a space is put in front and spaces are written U+2581. A code point
without a piece, and a U+2581 of the text itself, is written as byte pieces, so decoding gives every text back.

Defined cases: a null or empty text has no pieces and decodes to an empty text (null: null); rows that share
a key are drawn with the same numbers; a null key is a key of its own; other columns are kept.
"""

from __future__ import annotations

import sys
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from calorgrid.llm import kernel

THETA = 2e-4
SEED = 7
CACHE = 150_000
SLICE = 1 << 18
SPACE, OWN = 0x2581, sys.maxunicode + 1  # OWN: a U+2581 of the text
UNUSABLE = -1e8  # pieces with such scores are never chosen; single code points count as the least of the others
U = np.uint64


@lru_cache(4)
def load(path: str, theta: float) -> "Lattice":
    return Lattice(path, theta)


@lru_cache(4)
def pieces_of(path: str) -> "Pieces":
    return Pieces(path)


class Pieces:
    """The bytes of each piece, for decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, without the space in front, and the offset of each text."""
        size = self.raw_size[ids].copy()
        start = self.raw_start[ids].copy()
        head = offsets[:-1][offsets[1:] > offsets[:-1]]
        start[head] += 1
        size[head] -= 1
        total = np.concatenate([[0], np.cumsum(size)])
        return self.raw[kernel.ragged(start, size)], total[offsets]


class Lattice:
    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.theta = theta
        self.values = kernel.mix(np.arange(1, sys.maxunicode + 3, dtype=U) * U(0xD1342543DE82EF95))
        pieces = [(i, m.id_to_piece(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        usable = [(i, p) for i, p in pieces if m.get_score(i) > UNUSABLE or len(p) == 1]
        if any("▁" in p[1:] for _, p in usable):
            raise ValueError("a piece holds a space after its first place")
        self.piece_table = kernel.Table(17)
        flat = np.frombuffer("".join(p for _, p in usable).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for _, p in usable])
        self.piece_table.add(kernel.span_hash(self.values[flat], ends - [len(p) for _, p in usable], ends))
        self.piece_ids = np.array([i for i, _ in usable], np.int64)
        scores = np.array([m.get_score(i) for i, _ in usable])
        self.scores = np.maximum(scores, scores[scores > UNUSABLE].min())
        self.longest = max(len(p) for _, p in usable)
        self.unknown = self.scores.min() - 10.0
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.reset()

    def reset(self) -> None:
        self.chunks = kernel.Table()
        self.size = np.zeros(0, np.int64)  # code points of each chunk
        self.node = np.zeros(0, np.int64)  # its first node
        self.edge = np.zeros(0, np.int32)  # first incoming edge of each node
        self.fan = np.zeros(0, np.int8)  # incoming edges of each node
        self.upto, self.back, self.piece = np.zeros(0, np.float32), np.zeros(0, np.int8), np.zeros(0, np.int32)

    def learn(self, cps: np.ndarray, size: np.ndarray) -> None:
        """Forward filtering of new chunks, whose code points stand in a row."""
        n, ends = len(cps), np.cumsum(size)
        starts = ends - size
        end_of = np.repeat(ends, size)
        value, index = self.values[cps], np.arange(n)
        source, length, piece, score = [], [], [], []
        up, down = kernel.powers(n)
        total = np.zeros(n + 1, U)
        np.cumsum(value * up[:-1], out=total[1:])
        for k in range(1, self.longest + 1):
            s = index[index + k <= end_of]
            if not len(s):
                break
            row = self.piece_table.find(kernel.mix((total[s + k] - total[s]) * down[s] + np.full(1, k, U) * U(0xA0761D6478BD642F)))
            hit = row >= 0
            source.append(s[hit]), length.append(np.full(hit.sum(), k)), piece.append(self.piece_ids[row[hit]]), score.append(self.scores[row[hit]])
            if k == 1:  # code points without a piece
                lone = s[~hit]
                source.append(lone), length.append(np.ones(len(lone), np.int64)), piece.append(np.full(len(lone), -1)), score.append(np.full(len(lone), self.unknown))
        source, length, piece, score = map(np.concatenate, (source, length, piece, score))
        # node g of chunk c is numbered starts[c] + c + g; every chunk has one node more than code points
        chunk = np.repeat(np.arange(len(size)), size)
        a, b = source + chunk[source], source + length + chunk[source]
        step = source + length - starts[chunk[source]]
        order = np.lexsort((a, b, step))
        a, b, step, length, piece, score = a[order], b[order], step[order], length[order], piece[order], score[order] * self.theta
        alpha = np.zeros(n + len(size))
        weight = np.zeros(len(a))
        bounds = np.searchsorted(step, np.arange(1, int(step[-1]) + 2)) if len(step) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            v, to = alpha[a[lo:hi]] + score[lo:hi], b[lo:hi]
            head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            count = np.diff(np.append(head, len(to)))
            top = np.repeat(np.maximum.reduceat(v, head), count)
            w = np.exp(v - top)
            sums = np.add.reduceat(w, head)
            alpha[to[head]] = top[head] + np.log(sums)
            weight[lo:hi] = w / np.repeat(sums, count)
        order = np.lexsort((a, b))
        b, weight, length, piece = b[order], weight[order], length[order], piece[order]
        fan = np.bincount(b, minlength=n + len(size))
        first = np.cumsum(fan) - fan
        run = np.cumsum(weight)
        upto = run - np.repeat(np.append(0.0, run)[first], fan)
        nodes, edges = len(self.edge), len(self.upto)
        self.size = np.concatenate([self.size, size])
        self.node = np.concatenate([self.node, nodes + starts + np.arange(len(size))])
        self.edge = np.concatenate([self.edge, (edges + first).astype(np.int32)])
        self.fan = np.concatenate([self.fan, fan.astype(np.int8)])
        self.upto = np.concatenate([self.upto, upto.astype(np.float32)])
        self.back = np.concatenate([self.back, length.astype(np.int8)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in a row, and the offset of each text."""
        if self.chunks.n > CACHE:
            self.reset()
        plain, edge = kernel.code_points(data, offsets)
        full = edge[1:] > edge[:-1]
        n_texts = len(edge) - 1
        # a space in front of each text
        place = edge + np.concatenate([[0], np.cumsum(full)])
        cps = np.full(place[-1], SPACE, np.uint32)
        inside = np.ones(len(cps), bool)
        inside[place[:-1][full]] = False
        cps[inside] = np.where(plain == SPACE, OWN, np.where(plain == 0x20, SPACE, plain))
        starts = np.flatnonzero(cps == SPACE)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
        ends = np.append(starts[1:], len(cps))
        # a chunk ends with its text, since every text begins with a space
        h = kernel.span_hash(self.values[cps], starts, ends)
        row = self.chunks.find(h)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            self.learn(cps[kernel.ragged(starts[at], ends[at] - starts[at])], ends[at] - starts[at])
            self.chunks.add(new)
            row[miss] = self.chunks.find(h[miss])
        # backward sampling, one piece of every open chunk at a time
        owner = np.searchsorted(place, starts, side="right") - 1
        # among texts without a code point the last that starts here is the one that holds it
        key, base = keys[owner], place[owner]
        node, where = self.node[row] + self.size[row], ends.copy()
        first = self.node[row]
        out = np.full(len(cps), -2, np.int32)
        while len(node):
            draw = (kernel.mix(key + (where - base).astype(U) * U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) / (1 << 53)
            e = self.edge[node].astype(np.int64)
            stop = e + self.fan[node] - 1
            go = np.flatnonzero((self.upto[e] <= draw) & (e < stop))
            while len(go):
                e[go] += 1
                go = go[(self.upto[e[go]] <= draw[go]) & (e[go] < stop[go])]
            k = self.back[e].astype(np.int64)
            where = where - k
            out[where] = self.piece[e]
            node = node - k
            more = node > first
            if not more.all():
                node, first, where, key, base = node[more], first[more], where[more], key[more], base[more]
        taken = np.flatnonzero(out > -2)
        ids = out[taken].astype(np.int64)
        total = np.searchsorted(taken, place)
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # code points as bytes
            chars = cps[taken[lone]]
            chars = np.where(chars == OWN, SPACE, chars).astype(np.uint32)
            raw = [c.encode() for c in chars.tobytes().decode("utf-32-le")]
            count = np.ones(len(ids), np.int64)
            count[lone] = [len(r) for r in raw]
            begin = np.concatenate([[0], np.cumsum(count)])
            wide = np.repeat(ids, count)
            wide[kernel.ragged(begin[lone], count[lone])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            return wide, begin[total]
        return ids, total


def key_hash(keys: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number of each row key; of a key that is no integer the crc of its text."""
    if pa.types.is_integer(keys.type):
        whole = np.asarray(keys.fill_null(-(1 << 62)).cast(pa.int64())).astype(np.int64).view(U)
    else:
        whole = np.array([zlib.crc32(repr(k).encode()) for k in keys.to_pylist()], U)
    return kernel.mix(whole ^ kernel.mix(np.full(1, seed, U)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = SEED, decoded: str | None = None) -> DataFrame:
    """Add piece_ids, a sampled segmentation, and if `decoded` names a column, the text that its pieces give,
    in the same pass. Columns of these names are replaced."""
    names = ["piece_ids", *([decoded] if decoded else [])]
    docs = docs.drop(*names)

    def run(batches):
        lattice = load(path, theta)
        for batch in kernel.slices(batches, text, SLICE):
            data, offsets = kernel.flat(kernel.column(batch, text))
            ids, total = lattice.encode(data, offsets, key_hash(kernel.column(batch, key), seed))
            added = [pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                raw, at = pieces_of(path).decode(ids, np.asarray(total))
                whole = raw.tobytes()
                added.append(pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds))]))


def decode(docs: DataFrame, path: str, pieces: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Add the text of a column of piece ids; null ids give null. A column of the name `out` is replaced."""
    docs = docs.drop(out)

    def run(batches):
        known = pieces_of(path)
        for batch in batches:
            lists = kernel.column(batch, pieces)
            for at in range(0, batch.num_rows, 128):
                part = lists.slice(at, 128)
                offsets = np.concatenate([[0], np.cumsum(np.asarray(part.value_lengths().fill_null(0)))]).astype(np.int64)
                raw, total = known.decode(np.asarray(part.flatten()).astype(np.int64), offsets)
                whole = raw.tobytes()
                texts = [None if null else whole[a:b].decode("utf-8", "replace") for a, b, null in zip(total[:-1].tolist(), total[1:].tolist(), part.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 128).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])
            kernel.release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids (the whole sampled segmentation) and whether decoding gives the text back."""
    got = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return got.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("lossless"))
