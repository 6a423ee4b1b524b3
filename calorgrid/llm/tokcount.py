"""Exact token counts of every prefix, by dynamic programming over byte-level BPE.

For each prefix of a pretoken the program keeps its count and the last token of its encoding. A prefix ends
with token t after a shorter prefix that ends with s exactly if the merges would never join across s|t; that
is tested by undoing merges from the latest on. The counts of a text's prefixes follow by adding up its
pretokens; they are stored as differences, one 16-bit integer per code point, from which `count_at` and
`longest_within` answer questions on truncation and budgets without encoding again.

Defined cases: a null text is empty and has 0 tokens; ends of prefixes lie between code points; strings of
special tokens inside a text count as one token from their end on (inside them, as the text they would be);
other columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from calorgrid.llm import kernel, vocab

LIMIT = 512


@lru_cache(4)
def load(path: str) -> "Prefixes":
    return Prefixes(path)


class Prefixes(vocab.Bpe):
    """A vocabulary whose cache holds, for each pretoken, the count differences of its prefixes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.longest = max(map(len, self.tokens))
        special = {i for _, i in self.special}
        self.tokens = {t: i for t, i in self.tokens.items() if i not in special}
        self.rank, self.halves, self.pairs = {i: -1 for i in self.tokens.values()}, {}, {}
        ids = self.library.get_vocab()
        for k, (a, b) in enumerate(self.merges):
            a, b = ids[a], ids[b]
            made = self.library.token_to_id(self.library.id_to_token(a) + self.library.id_to_token(b))
            self.pairs[a, b] = (k, made)
            if made not in self.halves:
                self.halves[made], self.rank[made] = (a, b), k
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def separate(self, s: int, t: int) -> bool:
        """Whether the encoding of two tokens' texts in a row is just the two."""
        if (known := self.apart.get((s, t))) is not None:
            return known
        a, b, end, ok = s, t, len(self.merges), True
        while True:  # the states of both sides before each merge, latest first
            pair = self.pairs.get((a, b))
            if pair and pair[0] < end:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # At equal ranks the left one is merged first, so the right one is undone first; then a pair that
            # spans both would have to come strictly before the left one's merge.
            if ra > rb:
                end, a = ra, self.halves[a][1]
            else:
                end, b = rb + 1, self.halves[b][0]
        if len(self.apart) > vocab.CACHE:
            self.apart.clear()
        self.apart[s, t] = ok
        return ok

    def prefixes(self, raw: bytes) -> list[int]:
        """Tokens of raw[:0], raw[:1], ..., as one pretoken."""
        counts, last, tokens = [0], [-1], self.tokens
        for i in range(1, len(raw) + 1):
            for j in range(max(0, i - self.longest), i):
                t = tokens.get(raw[j:i])
                if t is None:
                    continue
                if j == 0:
                    if not self.alone(t):
                        continue
                elif not self.separate(last[j], t):
                    continue
                counts.append(counts[j] + 1)
                last.append(t)
                break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return counts

    def alone(self, t: int) -> bool:
        """Whether a token's text is encoded as that token: both its halves are, and nothing joins across
        them before the merge that makes it."""
        if (known := self.whole.get(t)) is None:
            known = True
            if t in self.halves:
                model = self.library.model
                known = [x.id for x in model.tokenize(self.library.id_to_token(t))] == [t]
            self.whole[t] = known
        return known

    def learn(self, pretokens: list[str]) -> None:
        parts = []
        for p in pretokens:
            raw = p.encode()
            if len(p) in (2, 3) and p[0] == "'" and p[1:] in vocab.CONTRACTIONS:
                # cut short, a contraction of three is an apostrophe and a letter
                c = [1, self.prefixes(raw)[2]] if len(p) == 2 else [1, 1 + self.prefixes(raw[1:2])[1], self.prefixes(raw)[3]]
            else:
                c = self.prefixes(raw)
                c = c[1:] if len(raw) == len(p) else [c[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            parts.append(c)
        n = np.array([len(c) for c in parts], np.int64)
        at = np.cumsum(n) - n
        counts = np.array([x for c in parts for x in c], np.int64)
        deltas = np.diff(counts, prepend=0)
        deltas[at] = counts[at]
        while self.used + len(deltas) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(deltas)] = deltas.astype(np.int64).view(np.uint64).astype(np.uint32)
        self.start = np.concatenate([self.start, self.used + at])
        self.count = np.concatenate([self.count, counts[at + n - 1]])
        self.used += len(deltas)

    def table_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(differences, first place of each text, tokens of each text)."""
        if self.table.n > vocab.CACHE:
            self.reset()
        text, cps, starts, ends, special, first, (run, last) = self.split(data, offsets)
        plain = special < 0
        p = np.flatnonzero(plain)
        extra = len(run)
        # spaces before something else: as a prefix the run with its last place is one pretoken
        s = np.concatenate([starts[p], run, run, last])
        e = np.concatenate([ends[p], last + 1, last, last + 1])
        rows = self.rows(text, cps, s, e)
        main = rows[: len(p)]
        deltas = np.zeros(len(cps), np.int64)
        size = ends[p] - starts[p]
        if len(p):
            deltas[kernel.ragged(starts[p], size)] = self.pool[kernel.ragged(self.start[main], size)].view(np.int32)
        if extra:
            whole, rest, one = (self.count[rows[len(p) + k * extra : len(p) + (k + 1) * extra]] for k in range(3))
            shift = whole - rest - one
            deltas[last] += shift
            deltas[last + 1] -= shift
        for k in np.flatnonzero(~plain):  # inside a special token its text counts; at its end it is one token
            inner = self.table_of(data_of(text[starts[k] : ends[k] - 1]), np.array([0, len(text[starts[k] : ends[k] - 1].encode())], np.int64))[0]
            deltas[starts[k] : ends[k] - 1] = inner
            deltas[ends[k] - 1] = 1 - inner.sum()
        total = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(deltas, out=total[1:])
        edge = np.append(starts, len(cps))[first]
        return deltas, edge, total[edge[1:]] - total[edge[:-1]]


def data_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def count(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, prefixes: bool = True) -> DataFrame:
    """Add n_bytes, n_tokens, over_limit and, if asked for, prefix_deltas (little-endian 16-bit integers,
    one per code point) to documents; columns of these names are replaced."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit", *(["prefix_deltas"] if prefixes else []))

    def run(batches):
        bpe = load(path)
        for batch in kernel.slices(batches, text):
            data, offsets = kernel.flat(kernel.column(batch, text))
            deltas, edge, n = bpe.table_of(data, offsets)
            columns = [*batch.columns, pa.array(offsets[1:] - offsets[:-1]), pa.array(n), pa.array(n > limit)]
            names = [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                small = deltas.astype("<i2")
                columns.append(pa.array([small[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary()))
                names.append("prefix_deltas")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"), *((("prefix_deltas", "binary"),) if prefixes else ())):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def count_at(deltas: bytes, chars: int) -> int:
    """Tokens of the first `chars` code points."""
    return int(np.frombuffer(deltas, "<i2")[:chars].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def digest(docs: DataFrame, path: str) -> DataFrame:
    got = count(docs.select("doc_id", "text"), path)
    return got.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.coalesce(F.octet_length("prefix_deltas") / 2, F.lit(0)).cast("long").alias("n_prefixes"))
