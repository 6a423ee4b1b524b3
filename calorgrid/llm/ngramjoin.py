"""Similarity join of word n-gram sets by prefix filtering and a prefix tree, and its components.

Sets of hashed shingles are put into one global order: shingles that many whole sets have last, the commonest at
the end, the others by hash. Two sets of Jaccard similarity t share a shingle among their first n - ceil(t n) + 1, and among the
first n - ceil(2 t / (1 + t) n) + 1 of the smaller one (its index prefix). The steps:

1. Of every set the first part by hash, long enough that two linked sets share an eighth of what must be equal
   (`sent`, `least_shared`), goes out as rows of hash and node. Sorted by hash they are read as a stream, and sets
   that share too little with any other link with nothing but their copies. Nothing is gathered: shingles that
   several sets of a slice have are counted there and go out once.
2. Of the others, equal sets are one node. Their prefixes are joined: in each group of a shared shingle only
   neighbours by size are compared at first, and what links is contracted.
3. Pairs of different components are compared. In groups of at most DENSE nodes pairs are counted of which the
   smaller has the shingle in its index prefix, and those that share fewer than any linked pair must are dropped.
   Nodes of larger groups form families, which are cut into blocks by size and bytes; blocks whose sizes differ by
   more than t, or which lie in one component, are left out.
4. Every comparison is made in blocks by a prefix tree: the sets of a block, in the global order, form a tree;
   it is traversed once for all probing sets, which share the partial overlaps along common paths, and a
   subtree is left when what remains of its longest set and of the probes cannot reach the overlap needed.

Steps 2 and 3 leave out pairs of one component, which is enough for components alone. Where links are counted
nothing is left out: the nodes that large groups put together form families, all pairs of a family are compared
in its blocks, each pair in one block, and all other pairs by the counts of step 3; a node counts for as many
links as documents have its set. The work of a family that is linked throughout thus grows with its links, but no
row and no memory does: its links are counted as they are found.

No cap drops a pair; the least ids of components follow from grouped minima. Shingles, sets and nodes are told
apart by 64-bit hashes. Keys that many rows share are spread (`hot`), and long groups are cut into chunks.

Defined cases: a null text and one without words has an empty set and links with nothing; repeated rows are
equal sets; a null doc_id takes part and counts for no minimum; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from calorgrid.llm import components, hot, kernel, store

WORDS = 5
PERCENT = 75
LONGER = 8  # first shingles beyond the prefix: one in so many
HEAVY = 32  # nodes with a shingle, from which it comes last in the global order
MAX_HEAVY = 1 << 17
DENSE = 128
BLOCK_BYTES = 1 << 21  # of the sets of a block
CHUNK = 1024  # nodes of a group that are put in order together
BROADCAST_IDS = 1 << 20  # 8 bytes each
PART = 1 << 19
NONE = (1 << 63) - 1  # stands for a null id
JOINED, LINK, COUNT = range(3)  # what a row a, b of blocks says: one component, a link, b links of a
U = np.uint64
_TOP = U(1 << 63)


def needed(a, b):
    """The least overlap of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n):
    return n - -(-PERCENT * n // 100) + 1


def index_size(n):
    """The first shingles of a set of which one is in the prefix of each linked set that is no smaller."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1


def sent(n):
    """How many first shingles by hash are held against those of others."""
    return n - -(-PERCENT * n // 100) + np.maximum(1, n // LONGER)


def least_shared(n: str):
    """The fewest of its first shingles that a set with a link shares with another's. Prefixes that are longer by
    k than the number of shingles that may differ share k, and the other set has t of this one's size at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(PERCENT * F.col(n) / F.lit(100)) / LONGER))


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 63-bit hashes."""
    h, first = kernel.shingles(data, offsets, WORDS)
    h &= _TOP - U(1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(first)))
    return [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 63-bit hashes, in steps of about PART bytes of text."""
    sets, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
        sets += _sets_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    return sets


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, node and n of each document, and the hash of its text if there is one."""
    more = [c for c in docs.columns if c == "text_hash"]

    def run(batches):
        for batch in kernel.slices(batches, "text"):
            sets = sets_of(*kernel.flat(kernel.column(batch, "text")))
            columns = [kernel.column(batch, "doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(kernel.column(batch, c) for c in more)], names=["doc_id", "node", "n", *more])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "node", "n", *more)))


ONE, SEVERAL = 0, -1  # in place of a count: a shingle of one set of a slice, of several


def _first_shingles(docs: DataFrame) -> DataFrame:
    """key, node and n: the first shingles of the sets, with ONE or SEVERAL as n, those that several sets of a slice
    have once; and of each set how many of these it has (its node as key, so that such rows go anywhere)."""

    def run(batches):
        for batch in kernel.slices(batches, "text", 1 << 22):
            sets = sets_of(*kernel.flat(kernel.column(batch, "text")))
            sets = list({node_of(s): s for s in sets if len(s)}.items())
            if not sets:
                continue
            node = np.array([k for k, _ in sets], np.int64)
            heads = [s[: sent(len(s))] for _, s in sets]
            h, owner = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(x) for x in heads])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(head, len(h)))
            local = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(sets))
            some = np.flatnonzero(local)
            key = np.concatenate([h[head].view(np.int64), node[some]])
            of = np.concatenate([node[owner[head]], node[some]])
            n = np.concatenate([np.where(size > 1, SEVERAL, ONE), local[some]]).astype(np.int32)
            for at in range(0, len(key), 1 << 16):
                columns = [pa.array(c[at : at + (1 << 16)]) for c in (key, of, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n"])

    return docs.mapInArrow(run, "key long, node long, n int")


def _shared(firsts: DataFrame) -> DataFrame:
    """node and shared: how many of its first shingles other sets have among theirs. Copies of a set in several
    slices may count what they share there more than once, which keeps a set at worst."""

    def run(batches):
        held = None  # the last shingle, its set and whether another set has it too: it may go on in the next batch
        for batch in batches:
            key, node, n = (np.asarray(kernel.column(batch, c)) for c in ("key", "node", "n"))
            counted = n > 0
            out = [(node[counted], n[counted])]
            key, node, several = key[~counted], node[~counted], n[~counted] == SEVERAL
            if len(key):
                if held is not None:
                    key, node, several = (np.append(x, y) for x, y in zip(held, (key, node, several)))
                new_key = np.append(True, key[1:] != key[:-1])
                new = new_key | np.append(True, node[1:] != node[:-1])
                run_of = np.cumsum(new_key) - 1
                both = (np.bincount(run_of[new]) > 1) | (np.bincount(run_of, several) > 0)
                got = node[new & ~several & both[run_of]]
                out.append((got, np.ones(len(got), np.int32)))
                held = (key[-1:], node[-1:], both[-1:])
            nodes, at = np.unique(np.concatenate([x for x, _ in out]), return_inverse=True)
            total = np.bincount(at, np.concatenate([y for _, y in out]), minlength=len(nodes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "shared"])

    rows = firsts.repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def ordered(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order, as sorted codes: light shingles by hash, then heavy ones by rank."""
    if not len(heavy):
        return s
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    hit = heavy[at] == s
    return np.sort(np.where(hit, _TOP | rank[at], s)) if hit.any() else s


def found_links(probes: np.ndarray, cands: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """Candidates and the probing sets that each links with, itself among them if it probes too, as positions in
    `sets`. A candidate comes again for each part of the probes; no pair is kept."""
    if not len(probes) or not len(cands):
        return
    # only shingles that both sides have matter; the sizes stay those of the whole sets
    both = np.intersect1d(np.unique(np.concatenate([sets[p] for p in probes])), np.unique(np.concatenate([sets[c] for c in cands])), assume_unique=True)
    if not len(both):
        return

    def codes(k):
        at = np.searchsorted(both, sets[k])
        at[at == len(both)] = 0
        return at[both[at] == sets[k]]

    seqs = [codes(c) for c in cands]
    order = sorted(range(len(cands)), key=lambda k: seqs[k].tolist())
    cands, seqs = cands[order], [seqs[k] for k in order]

    def common(x, y):
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m

    lcp = [0, *(common(a, b) for a, b in zip(seqs[:-1], seqs[1:])), 0]
    step = max(1, (1 << 22) // len(both))
    for p0 in range(0, len(probes), step):
        some = probes[p0 : p0 + step]
        has = np.zeros((len(both), len(some)), np.uint8)
        for j, p in enumerate(some):
            has[codes(p), j] = 1
        after = np.cumsum(has[::-1], axis=0, dtype=np.int32)[::-1]  # a probe's shingles from each on
        psize, i = sizes[some], 0
        stack = [(0, np.zeros(len(some), np.int32))]
        while i < len(cands):
            seq = seqs[i]
            while stack[-1][0] > lcp[i]:
                stack.pop()
            depth, overlap = stack[-1]
            branch = lcp[i + 1]
            if branch > depth:  # the path that the next sets share
                j, least, longest = i, sizes[cands[i]], 0
                while j < len(cands) and (j == i or lcp[j] >= branch):
                    least, longest = min(least, sizes[cands[j]]), max(longest, len(seqs[j]) - branch)
                    j += 1
                overlap = overlap + has[seq[depth:branch]].sum(axis=0, dtype=np.int32)
                depth = branch
                rest = after[seq[branch - 1] + 1] if seq[branch - 1] + 1 < len(both) else np.zeros(len(some), np.int32)
                if not (overlap + np.minimum(rest, longest) >= needed(psize, least)).any():
                    while stack[-1][0] > lcp[j] if j < len(cands) else len(stack) > 1:
                        stack.pop()
                    i = j
                    if i < len(cands) and stack[-1][0] < lcp[i]:
                        d, o = stack[-1]
                        stack.append((lcp[i], o + has[seqs[i][d : lcp[i]]].sum(axis=0, dtype=np.int32)))
                    continue
                stack.append((depth, overlap))
            elif branch < depth and not any(d == branch for d, _ in stack):
                d, o = next((d, o) for d, o in reversed(stack) if d <= branch)
                at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] <= branch)
                stack.insert(at + 1, (branch, o + has[seq[d:branch]].sum(axis=0, dtype=np.int32)))
            goal = needed(psize, sizes[cands[i]])
            left = len(seq) - depth
            if (overlap + left >= goal).any():
                got = overlap + has[seq[depth:]].sum(axis=0, dtype=np.int32)
                if (got >= goal).any():
                    yield some[got >= goal], cands[i]
            i += 1


def tree_join(nodes: np.ndarray, probes: np.ndarray, cands: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between probing sets and candidate sets, as a spanning forest: pairs that are in one component, given
    or found before, are not reported again."""
    root, links = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for found, b in found_links(probes, cands, sizes, sets):
        for a in found:
            if a != b and find(("c", comp[a])) != find(("c", comp[b])):
                root[find(("c", comp[a]))] = find(("c", comp[b]))
                links.append((int(nodes[a]), int(nodes[b])))
    return links


def listed_links(probes: np.ndarray, cands: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], comp: np.ndarray) -> np.ndarray:
    """All linked pairs of different components, as positions, the lower first, each once."""
    links = [np.zeros((0, 2), np.int64)]
    for a, b in found_links(probes, cands, sizes, sets):
        a = a[comp[a] != comp[b]]
        links.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.unique(np.concatenate(links), axis=0)


def counted_links(probes: np.ndarray, cands: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the documents of the sets of other components that it links with, and the least position
    that links join it to. Links are counted as they are found, so that memory follows the sets and not the links."""
    n, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    probing, other = np.zeros(len(sets), bool), np.ones(len(sets), bool)
    probing[probes], other[cands] = True, False
    for a, b in found_links(probes, cands, sizes, sets):
        a = a[comp[a] != comp[b]]
        n[b] += copies[a].sum()
        # where both probe and are candidates, the pair comes a second time, the other way round
        n[a[other[a]] if probing[b] else a] += copies[b]
        if (label[a] != label[b]).any():
            joined = np.zeros(len(sets), bool)
            joined[label[a]] = joined[label[b]] = True
            label[joined[label]] = np.argmax(joined)
    return n, label


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n positions that pairs a, b join each to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(rows: DataFrame) -> DataFrame:
    """Links a, b of blocks: rows block, probe, cand (booleans), node, comp, toks."""

    def run(table: pa.Table) -> pa.Table:
        probe, cand = (np.asarray(table.column(c).combine_chunks()).astype(bool) for c in ("probe", "cand"))
        node = np.asarray(table.column("node").combine_chunks())
        nodes, at = np.unique(node, return_inverse=True)
        is_probe, is_cand = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
        np.logical_or.at(is_probe, at, probe)
        np.logical_or.at(is_cand, at, cand)
        sets, comp = [None] * len(nodes), np.zeros(len(nodes), np.int64)
        for k, toks, c in zip(at.tolist(), table.column("toks").to_pylist(), table.column("comp").to_pylist()):
            sets[k], comp[k] = np.frombuffer(toks, "<u8"), c
        sizes = np.array([len(s) for s in sets], np.int64)
        probes, cands = np.flatnonzero(is_probe), np.flatnonzero(is_cand)
        links = tree_join(nodes, probes, cands, sizes, sets, comp)
        kernel.release()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("block").applyInArrow(run, "a long, b long")


def _every_link(rows: DataFrame, count: bool) -> DataFrame:
    """All links of blocks as rows kind, a, b: what is joined, and each link, or if `count` the number of
    linked documents of each node; rows as in _blocks, and copies, the documents of a node."""

    def run(table: pa.Table) -> pa.Table:
        node, at, back = np.unique(np.asarray(table.column("node").combine_chunks()), return_index=True, return_inverse=True)
        probe, cand = (np.bincount(back, np.asarray(table.column(c).combine_chunks()).astype(float)) > 0 for c in ("probe", "cand"))
        comp, copies = (np.asarray(table.column(c).combine_chunks())[at] for c in ("comp", "copies"))
        sets = [np.frombuffer(t, "<u8") for t in table.column("toks").take(pa.array(at)).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        probes, cands = np.flatnonzero(probe), np.flatnonzero(cand)
        if count:
            n, label = counted_links(probes, cands, sizes, sets, comp, copies)
            some = np.flatnonzero(n)
            out = [(COUNT, node[some], n[some])]
        else:
            a, b = listed_links(probes, cands, sizes, sets, comp).T
            label = least_joined(len(node), a, b)
            out = [(LINK, node[a], node[b])]
        own = np.flatnonzero(label != np.arange(len(node)))
        out.append((JOINED, node[own], node[label[own]]))
        kernel.release()
        kind = np.repeat(np.array([k for k, _, _ in out], np.int32), [len(x) for _, x, _ in out])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([x for _, x, _ in out])), "b": pa.array(np.concatenate([y for _, _, y in out]))})

    return rows.groupBy("block").applyInArrow(run, "kind int, a long, b long")


def _sides(pairs: DataFrame) -> DataFrame:
    """block, node, probe and cand of the two ends of pairs block, a, b."""
    a = pairs.select("block", F.col("a").alias("node"), F.lit(True).alias("probe"), F.lit(False).alias("cand"))
    return a.union(pairs.select("block", F.col("b").alias("node"), F.lit(False).alias("probe"), F.lit(True).alias("cand")))


def _compare_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among given pairs a, b: pairs of about the same a share a block."""
    n = pairs.count()
    width = max(1, n // 256)
    keyed = pairs.select(F.pmod(F.xxhash64("a"), F.lit(width)).alias("block"), "a", "b")
    return _blocks(_sides(keyed).distinct().join(sets.select("node", "toks", F.col("node").alias("comp")), "node"))


def _pair_counts(entries: DataFrame) -> DataFrame:
    """a, b, na, nb and shared of pairs of different components in groups of a key: rows key, node, n, index and
    comp, whole groups of at most DENSE nodes. shared counts the keys that the smaller set has in its index prefix.
    Where a node stands twice with a key, the row whose comp is not the node itself holds."""

    def run(batches):
        rest = None

        def of(t):
            columns = [np.asarray(t.column(c).combine_chunks()) for c in ("key", "node", "n", "index", "comp")]
            first = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
            key, node, n, index, comp = (c[first] for c in columns)
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            a, b = [], []
            for s, e in zip(head.tolist(), [*head[1:].tolist(), len(key)]):
                i, j = np.triu_indices(e - s, 1)
                i, j = i + s, j + s
                use = index[i] & (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
                a.append(i[use]), b.append(j[use])
            a, b = np.concatenate(a), np.concatenate(b)
            turn = node[a] > node[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            got = np.stack([node[a], node[b], n[a], n[b]], 1)
            got, count = np.unique(got, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(got[:, k]) for k in range(4)), pa.array(count)], names=["a", "b", "na", "nb", "shared"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = np.asarray(t.column("key").combine_chunks())
            if not len(key):
                continue
            cut = int(np.flatnonzero(key == key[-1])[0])
            rest = t.slice(cut)
            if cut:
                yield of(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield of(rest)

    rows = entries.select("key", "node", "n", "index", "comp").repartition("key").sortWithinPartitions("key", "n", "node", F.col("comp") == F.col("node"))
    found = rows.mapInArrow(run, "a long, b long, na long, nb long, shared long")
    return found.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("shared").alias("shared"))


def _chunk():
    """A part of a group of at most about CHUNK nodes."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("g") / CHUNK)).alias("chunk")


def _family_of(entries: DataFrame) -> DataFrame:
    """node and component of the nodes that groups of more than DENSE nodes put together."""
    rows = entries.select("key", _chunk(), "node")
    hubs = rows.groupBy("key", "chunk").agg(F.min("node").alias("hub"))
    top = hubs.groupBy("key").agg(F.min("hub").alias("top"))
    inside = rows.join(hubs, ["key", "chunk"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components.components(inside.union(hubs.join(top, "key").select(F.col("hub").alias("a"), F.col("top").alias("b"))))


def _family_blocks(family: DataFrame, sets: DataFrame, comp: DataFrame, tables: store.Scratch) -> DataFrame:
    """The blocks that hold each pair of a family which may be linked, and is not of one comp, once."""
    # a linked pair lies in one band of sizes or in two that follow each other
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)) * (1 + 1e-9))).cast("int")
    rows = family.join(sets.select("node", "n"), "node").join(comp, "node", "left")
    rows = tables.cut(rows.select("node", "n", "component", band.alias("band"), F.coalesce("comp", "node").alias("comp")), "family")
    parts = F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES).cast("int")
    blocks = tables.cut(rows.groupBy("component", "band").agg(parts.alias("parts"), F.count("*").alias("_n")), "bands")
    rows = hot.spread_join(rows.drop("n"), blocks, ["component", "band"], "_n", "node")
    rows = tables.cut(rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts", "_n"), "family")
    each = rows.groupBy("component", "band", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = each.withColumn("next", F.explode(F.array("band", F.col("band") + 1)))
    other = each.select(F.col("component").alias("c2"), F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = near.join(other, (F.col("component") == F.col("c2")) & (F.col("next") == F.col("band2"))).where("band <> band2 or part <= part2").where("least(lo, lo2) <> greatest(hi, hi2)")
    pairs = pairs.select("component", F.xxhash64("component", "band", "part", "band2", "part2").alias("block"), "band", "part", "band2", "part2")
    sides = pairs.select("component", "block", "band", "part", F.lit(True).alias("probe"), F.lit(False).alias("cand")).union(pairs.select("component", "block", F.col("band2").alias("band"), F.col("part2").alias("part"), F.lit(False).alias("probe"), F.lit(True).alias("cand")))
    return rows.select("component", "band", "part", "node", "comp").join(sides, ["component", "band", "part"]).join(sets.select("node", "toks"), "node").select("block", "probe", "cand", "node", "comp", "toks")


def _fewest(na: str, nb: str):
    """The least number of shingles in both the index prefix of the smaller and the prefix of the larger of two
    linked sets: the overlap needed, less what may lie behind either prefix."""
    n, larger, smaller = F.col(na) + F.col(nb), F.greatest(na, nb), F.least(na, nb)
    behind = F.greatest(F.ceil(PERCENT * larger / F.lit(100)), F.ceil(2 * PERCENT * smaller / F.lit(100 + PERCENT)))
    return F.ceil(PERCENT * n / F.lit(100 + PERCENT)) - behind + 1


def _all_links(entries: DataFrame, sets: DataFrame, nodes: DataFrame, tables: store.Scratch) -> tuple[DataFrame, DataFrame]:
    """a, b that join the nodes of each component, and node and linked (documents of the nodes linked to it)."""
    copies = nodes.select("node", "copies")
    family = _family_of(entries.where(F.col("g") > DENSE))
    blocks = _family_blocks(family, sets, nodes.select("node", F.col("node").alias("comp")), tables)
    inside = tables.cut(_every_link(blocks.join(copies, "node"), True), "links")
    # pairs of one family are settled; others share no large group, so that small groups count all that they share
    small = entries.where(F.col("g") <= DENSE).select("key", "node", "n", "index")
    # most sets are in no family: only the shingles of those that are meet it
    rows = small.withColumn("comp", F.col("node")).union(small.join(family, "node").select("key", "node", "n", "index", "component"))
    pairs = tables.cut(_pair_counts(rows).where(F.col("shared") >= _fewest("na", "nb")).select("a", "b"), "pairs")
    # pairs around one least node share a block, so that a set is seldom sent twice
    ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    hub = ends.groupBy("node").agg(F.min("other").alias("hub"))
    width = max(1, pairs.count() // 256)
    keyed = pairs.join(hub, F.col("a") == F.col("node")).select(F.pmod(F.xxhash64("hub"), F.lit(width)).alias("block"), "a", "b")
    sides = _sides(keyed).groupBy("block", "node").agg(F.max("probe").alias("probe"), F.max("cand").alias("cand"))
    placed = sides.join(sets.select("node", "toks"), "node").join(copies, "node").join(family, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    outside = tables.cut(_every_link(placed, False), "links")
    # a block may also link two of its nodes whose pair belongs to another
    links = outside.where(F.col("kind") == LINK).select("a", "b").distinct()
    ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = ends.join(copies.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
    found = found.union(inside.where(F.col("kind") == COUNT).select(F.col("a").alias("node"), F.col("b").alias("n")))
    return inside.union(outside).where(F.col("kind") == JOINED).select("a", "b"), found.groupBy("node").agg(F.sum("n").alias("linked"))


def _joining_links(entries: DataFrame, sets: DataFrame, tables: store.Scratch) -> DataFrame:
    """Links a, b that join the nodes of each component."""
    by_size = Window.partitionBy("key", "chunk").orderBy("n", "node")
    chain = entries.withColumn("chunk", _chunk()).select("node", "n", F.lead("node").over(by_size).alias("b"), F.lead("n").over(by_size).alias("nb"))
    chain = chain.where(f"b is not null and 100 * n >= {PERCENT} * nb").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    links = tables.cut(_compare_pairs(tables.cut(chain, "pairs"), sets), "links")
    comp = components.components(links).select("node", F.col("component").alias("comp"))

    with_comp = entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("_n")).where("lo <> hi").drop("lo", "hi")
    with_comp = tables.cut(hot.spread_join(with_comp, tables.cut(mixed, "keys"), ["key"], "_n", "node").drop("_n"), "mixed")
    light = _pair_counts(with_comp.where(F.col("g") <= DENSE)).where(F.col("shared") >= _fewest("na", "nb")).select("a", "b")
    links2 = _compare_pairs(tables.cut(light, "pairs"), sets)
    links3 = _blocks(_family_blocks(_family_of(with_comp.where(F.col("g") > DENSE)), sets, comp, tables))
    return tables.cut(links.union(links2).union(links3), "links")


def _prefixes(batches):
    """key, node, n and index (whether it lies in the index prefix) of the prefixes of sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n = np.asarray(kernel.column(part, "n"))
            count = prefix_size(n)
            p = [np.frombuffer(t, "<u8")[:k] for t, k in zip(kernel.column(part, "toks").to_pylist(), count.tolist())]
            index = kernel.ragged(np.zeros(len(n), np.int64), count) < np.repeat(index_size(n), count)
            columns = [np.concatenate(p).view(np.int64), np.repeat(np.asarray(kernel.column(part, "node")), count), np.repeat(n, count), index]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "index"])


ENTRIES = "key long, node long, n long, index boolean"


def _entries(sets: DataFrame, tables: store.Scratch) -> DataFrame:
    """Prefix shingles of the sets in groups g in which some pair may meet, the smaller with its index prefix."""
    entries = sets.mapInArrow(_prefixes, ENTRIES)
    size = F.struct("n", "node")
    groups = entries.groupBy("key").agg(F.count("*").alias("g"), F.min(F.when(F.col("index"), size)).alias("_least")).where("g > 1 and _least is not null")
    joined = hot.spread_join(entries, tables.cut(groups, "groups"), ["key"], "g", "node")
    return tables.cut(joined.where(F.col("index") | (size > F.col("_least"))).drop("_least"), "entries")


def _counts(batches):
    """key and c: how many sets of a slice have each shingle. Whole sets count: what is frequent must not move into
    the prefixes of the new order because it lay behind those of the old one."""
    for batch in kernel.slices(batches, "toks", 1 << 22):
        data, _ = kernel.flat(kernel.column(batch, "toks"))
        key, c = np.unique(np.frombuffer(data.tobytes(), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], names=["key", "c"])


def _global_order(raw: DataFrame) -> DataFrame:
    """The sets with their shingles in the global order."""
    common = raw.mapInArrow(_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > HEAVY)
    found = common.orderBy(F.desc("c"), "key").limit(MAX_HEAVY).toArrow()  # at most MAX_HEAVY rows
    heavy = np.asarray(found.column("key").combine_chunks()).astype(np.int64).view(U)
    rank = np.arange(len(heavy), 0, -1).astype(U)  # the most frequent last
    by = np.argsort(heavy)
    shared = raw.sparkSession.sparkContext.broadcast((heavy[by], rank[by]))

    def reorder(batches):
        hv, rk = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                toks = [ordered(np.frombuffer(t, "<u8"), hv, rk).tobytes() for t in kernel.column(part, "toks").to_pylist()]
                yield pa.RecordBatch.from_arrays([kernel.column(part, "node"), kernel.column(part, "n"), pa.array(toks, pa.binary())], names=["node", "n", "toks"])

    return raw.mapInArrow(reorder, "node long, n long, toks binary")


def _whole_sets(batches):
    for batch in kernel.slices(batches, "text"):
        sets = sets_of(*kernel.flat(kernel.column(batch, "text")))
        columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "toks"])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", links: bool = True, groups: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and n_links (the other rows that it
    links with, those of an equal set among them) of each row of documents; without `links` no n_links, for
    which pairs of one component need not be compared. With `groups` also text_hash (xxhash64 of the text) and
    group, equal for the rows of one component and for no others (null without shingles): ids may repeat, so
    component_id alone doesn't tell components apart."""
    spark = docs.sparkSession
    none = F.lit(NONE)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), none).alias("doc_id"), F.col(text).alias("text"))
    all_docs = store.cut(_sizes(rows.withColumn("text_hash", F.xxhash64("text")) if groups else rows), "sizes")
    with store.Scratch(spark, "ngram-join") as tables:
        nodes = tables.cut(all_docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("copies")), "nodes")
        near = _shared(_first_shingles(rows)).join(nodes, "node").where(F.col("shared") >= least_shared("n"))
        open_ = tables.cut(near.select("node", "first_id"), "open")
        ids = open_.select(F.col("first_id").alias("doc_id")).distinct()
        if open_.count() <= BROADCAST_IDS:  # or else the texts are shuffled once
            ids = F.broadcast(ids)
        chosen = rows.join(ids, "doc_id", "left_semi")
        raw = chosen.mapInArrow(_whole_sets, "node long, n long, toks binary").join(open_.select("node"), "node", "left_semi").dropDuplicates(["node"])
        raw = tables.cut(raw, "raw-sets")
        sets = tables.cut(_global_order(raw), "sets")
        tables.drop(raw)
        entries = _entries(sets, tables)
        if links:
            every, linked = _all_links(entries, sets, nodes, tables)
        else:
            every, linked = _joining_links(entries, sets, tables), None
        last = components.components(every)
        joined = tables.cut(nodes.join(last, "node"), "joined")
        ids = joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n"))
        found = hot.spread_join(joined.select("node", "component"), tables.cut(ids, "ids"), ["component"], "_n", "node").select("node", "component", "component_id")
        found = nodes.join(found, "node", "left").select("node", "copies", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "first_id").alias("component_id"))
        if links:
            found = found.join(linked, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)))
        found = store.cut(found, "nodes")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    more += ["text_hash", F.when(F.col("n") > 0, F.col("group")).alias("group")] if groups else []
    out = hot.spread_join(all_docs, found, ["node"], "copies", "doc_id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.nullif("doc_id", none).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, none).alias("component_id"), *more)
