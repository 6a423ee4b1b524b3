"""Byte-level BPE vocabularies over Arrow batches.

Texts are split into pretokens in numpy, by the rule of the vocabulary's own pattern; the tokenizers library
encodes each distinct pretoken once, and a batch is put together from those by ragged gathers. Pretokens are
told apart by 64-bit hashes. The cache lives with the Python worker and is emptied beyond CACHE entries.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from calorgrid.llm import kernel

CACHE = 2_000_000
#: The character that stands for each byte: itself if it is printable, else the next from U+0100 on.
_SHOWN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
BYTE_CHARS = {b: b if b in _SHOWN else 0x100 + b - sum(x < b for x in _SHOWN) for b in range(256)}
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The pattern of the ByteLevel pretokenizer; fixed values of the contractions that it knows.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def _classes() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    table = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(1)
def _code_values() -> np.ndarray:
    return kernel.mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(4)
def load(path: str) -> "Bpe":
    return Bpe(path)


class Bpe:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE with the usual pattern")
        self.library = Tokenizer.from_file(path)
        self.special = sorted(((t["content"].encode(), t["id"]) for t in spec["added_tokens"]), key=lambda t: -len(t[0]))
        back = {chr(c): b for b, c in BYTE_CHARS.items()}
        self.tokens = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.reset()

    def reset(self) -> None:
        self.table = kernel.Table()
        self.pool, self.used = np.zeros(1024, np.uint32), 0
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges that are split on their own, and the id of each that is a special token, else -1."""
        cuts, raw = {int(x): -1 for x in offsets}, None
        for content, i in self.special:
            raw = raw if raw is not None else data.tobytes()
            at = raw.find(content)
            while at >= 0:
                to = at + len(content)
                if int(np.searchsorted(offsets, at, "right")) == int(np.searchsorted(offsets, to - 1, "right")) and cuts.get(at, -1) < 0:
                    cuts[at] = i
                    cuts.setdefault(to, -1)
                at = raw.find(content, to)
        at = np.array(sorted(cuts), np.int64)
        return at, np.array([cuts[int(x)] for x in at], np.int64)

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """(text, code points, starts, ends, special, first, runs): the pretokens of all texts as spans of
        code points, the special id or -1 of each, and the first of each text. runs: for each run of two or
        more spaces before something else, its start and its last place."""
        edges, ids = self.segments(data, offsets)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=total[1:])
        text = data.tobytes().decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, edge = len(cps), total[edges]
        empty = np.zeros(0, np.int64)
        if not n:
            return text, cps, empty, empty, empty, np.zeros(len(offsets), np.int64), (empty, empty)
        kind = _classes()[cps]
        cut = np.zeros(n + 1, bool)
        cut[edge] = True
        space, blank = kind == SPACE, cps == 0x20
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | cut[1:-1]
        head = change.copy()  # a run of one class starts here
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1] & ~cut[1:-1]
        head &= ~(after_blank & ~space)  # the blank before it belongs to it
        last = np.zeros(n, bool)  # the last space before something else
        last[:-1] = space[:-1] & ~space[1:] & ~cut[1:-1]
        head |= last
        # contractions: an apostrophe that starts a pretoken, and what follows
        quote = np.flatnonzero((cps == 0x27) & head)
        for tail in CONTRACTIONS:
            k = len(tail)
            q = quote[quote + k < n]
            hit = np.ones(len(q), bool)
            for j, c in enumerate(tail, 1):
                hit &= (cps[q + j] == ord(c)) & ~cut[q + j]
            q = q[hit]
            head[q + 1] = False
            more = q + k + 1
            head[more[more < n]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], n)
        special = np.full(len(starts), -1, np.int64)
        if (ids >= 0).any():
            # the pretokens inside a special token become one
            inside = np.zeros(n, bool)
            for k in np.flatnonzero(ids >= 0):
                inside[edge[k] + 1 : edge[k + 1]] = True
            starts = starts[~inside[starts]]
            ends = np.append(starts[1:], n)
            special = np.full(len(starts), -1, np.int64)
            special[np.searchsorted(starts, edge[ids >= 0])] = ids[ids >= 0]
            last &= ~inside
        at = np.flatnonzero(last)
        begin = np.maximum.accumulate(np.where(change, np.arange(n), 0))[at] if len(at) else at
        long = at > begin
        return text, cps, starts, ends, special, np.searchsorted(starts, total[offsets]), (begin[long], at[long])

    def hashes(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return kernel.span_hash(_code_values()[cps], starts, ends)

    def rows(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's row of each span; spans that are new are encoded by the library."""
        h = self.hashes(cps, starts, ends)
        got = self.table.find(h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            self.learn([text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            self.table.add(new)
            got[miss] = self.table.find(h[miss])
        return got

    def learn(self, pretokens: list[str]) -> None:
        ids, counts = self.by_library(pretokens)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.used += len(ids)

    def by_library(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of each pretoken, from the library's own model."""
        model = self.library.model
        parts = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(BYTE_CHARS))] for p in pretokens]
        return np.array([i for p in parts for i in p], np.uint32), np.array([len(p) for p in parts], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and the offset of each text."""
        if self.table.n > CACHE:
            self.reset()
        text, cps, starts, ends, special, first, _ = self.split(data, offsets)
        plain = special < 0
        rows = np.zeros(len(starts), np.int64)
        rows[plain] = self.rows(text, cps, starts[plain], ends[plain])
        n = np.where(plain, self.count[rows] if len(self.count) else 0, 1)
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ids = self.pool[kernel.ragged(np.where(plain, self.start[rows] if len(self.start) else 0, 0), n)]
        ids[total[:-1][~plain]] = special[~plain]
        return ids, total[first]
