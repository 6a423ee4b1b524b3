"""Near-duplicate groups and repeated lines against brute force."""

import random
import re

from calorgrid.llm import hot, linededup, ngramjoin
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(rows):
    """doc_id -> (size, least linked id) by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def planted(seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        words = prose(rng, rng.choice([3, 5, 6, 12, 40, 200])).split()
        rows.append(words)
        for _ in range(rng.randrange(6)):  # chains of edits, near the threshold
            words = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30, 2 + len(words) // 20)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
            rows.append(words)
    common = prose(rng, 60).split()
    for _ in range(150):  # a group of near copies
        words = list(common)
        words[rng.randrange(60)] = "other" + str(rng.randrange(5))
        rows.append(words)
    rng.shuffle(rows)
    return [(i * 3 - 50, " ".join(w)) for i, w in enumerate(rows)]


def test_join_tables(docs):
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, ngramjoin.join(docs).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_join_planted(spark):
    rows = planted()
    d = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, ngramjoin.join(d).select("doc_id", "n_shingles", "component_id").collect())) == groups(rows)


def test_join_edges(edge, edge_rows):
    got = ngramjoin.join(edge).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == by[6]["component_id"] == 5
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[1]["component_id"] == 1 and by[2]["component_id"] == 2


def n_links(rows):
    """doc_id -> rows of which the set is linked, by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    n = {k: 0 for k, _ in sets}
    for i, (k, a) in enumerate(sets):
        for other, b in sets[:i]:
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                n[k] += 1
                n[other] += 1
    return n


def test_links_planted(spark):
    """All links are counted, within groups of near copies too; what families and small groups do is the same."""
    rows = planted(4)
    rows += [(k + 10000, t) for k, t in rows[:60]]  # equal sets
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = n_links(rows)
    assert {r["doc_id"]: r["n_links"] for r in ngramjoin.join(d).collect()} == want
    assert max(want.values()) > ngramjoin.DENSE
    once, twice = (sorted(map(tuple, x.select("doc_id", "n_shingles", "component_id").collect())) for x in (ngramjoin.join(d), ngramjoin.join(d, links=False)))
    assert once == twice


def test_links_tables(docs):
    want = n_links([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["n_links"] for r in ngramjoin.join(docs).collect()} == want


def templated(n, paragraphs=40, least=4, most=9, words=30, seed=8):
    """Texts put together from shared paragraphs, a tenth of their words edited in some."""
    rng = random.Random(seed)
    shared = [prose(rng, words) for _ in range(paragraphs)]
    rows = []
    for k in range(n):
        text = " ".join(rng.sample(shared, rng.randrange(least, most)))
        if k % 3 == 0 and rows:
            text = rng.choice(rows)[1]
            w = text.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
            text = " ".join(w)
        rows.append((k, text))
    return rows


def test_families_in_several_blocks(spark, monkeypatch):
    """Small bounds, so that groups are cut into chunks, families into blocks, and hot keys are spread."""
    monkeypatch.setattr(ngramjoin, "BLOCK_BYTES", 1 << 15)
    monkeypatch.setattr(ngramjoin, "CHUNK", 64)
    monkeypatch.setattr(hot, "HOT", 40)
    rows = templated(900)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = ngramjoin.join(d).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == n_links(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(rows)
    once = ngramjoin.join(d, links=False).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, once)) == groups(rows)


def test_first_shingles_keep_linked_sets(spark, monkeypatch):
    """Whatever is left out before sets are joined has no link: sets of all sizes near the threshold."""
    rng = random.Random(2)
    rows, vocabulary = [], [f"w{i}" for i in range(4000)]
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 7, 8, 9, 11, 14, 20, 60]))]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words[rng.randrange(3) :] + [rng.choice(vocabulary)] * rng.randrange(3))))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert {r["doc_id"]: r["n_links"] for r in ngramjoin.join(d).collect()} == n_links(rows)


def lines_of(text):
    return [x.strip(" \t\n\r\v\f") for x in (text or "").split("\n") if WORD.search(x)]


def by_hand(rows):
    """The operator's definition with plain loops, against all earlier places: doc_id -> lines that stay."""
    docs = {k: lines_of(text) for k, text in rows}
    earliest, runs = {}, []
    for k in sorted(docs):
        own = docs[k]
        n = [len(WORD.findall(x)) for x in own]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(n[i:j]) >= linededup.GUARANTEE:
                    runs.append((k, i, j))
                    earliest.setdefault(tuple(own[i:j]), (k, i))
                if sum(n[i + 1 : j - 1]) >= linededup.GUARANTEE:
                    break  # longer runs that two places share hold a shorter one around each of their lines
    gone = {k: set() for k in docs}
    for k, i, j in runs:
        if earliest[tuple(docs[k][i:j])] != (k, i):
            gone[k] |= set(range(i, j))
    return {k: [x for i, x in enumerate(own) if i not in gone[k]] for k, own in docs.items()}


def test_lines_tables(docs):
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: lines_of(r["text"]) for r in linededup.dedup(docs).collect()}
    assert got == want


def test_lines_planted(spark):
    """Runs of lines with over 50 words stand once, and lines that stand alone stay."""
    rng = random.Random(8)
    run = [prose(rng, 9) for _ in range(9)]
    rows = []
    for k in range(30):
        own = [prose(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(3, 30))]
        at = rng.randrange(len(own))
        rows.append((k, "\n".join([*own[:at], *(run if k % 2 else []), *own[at:]])))
    got = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        left = lines_of(got[k]["text"])
        want = lines_of(text)
        assert left == ([x for x in want if x not in run] if k % 2 and k > 1 else want)
        assert got[k]["n_removed"] == len(want) - len(left) and got[k]["n_lines"] == len(want)
    assert {k: lines_of(r["text"]) for k, r in got.items()} == by_hand(rows)


def test_lines_short_runs(spark):
    """Single lines of GRAM_WORDS words and texts of fewer than 50 words stand once."""
    rng = random.Random(9)
    line, text = prose(rng, 25), "\n".join(prose(rng, 10) for _ in range(3))
    rows = [(1, prose(rng, 40) + "\n" + line + "\n" + prose(rng, 9)), (2, prose(rng, 8) + "\n" + line), (3, line), (4, text), (5, text)]
    got = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["n_removed"] for k, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 3}
    assert got[2]["text"] == rows[1][1].split("\n")[0] and got[3]["text"] == got[5]["text"] == ""


def test_lines_beyond_the_first_place(spark):
    """A run that goes on longer at a later place than at the first is a repeat of that later place."""
    rng = random.Random(4)
    a, b, c, d = (prose(rng, n) for n in (13, 13, 10, 9))
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{d}\n{a}\n{b}\n{c}"), (5, f"{c}\n{d}\n{a}\n{b}"), (6, f"{d}\n{a}")]
    got = {r["doc_id"]: lines_of(r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows) == {1: [a, b], 2: [c], 3: [], 4: [d], 5: [c], 6: [d, a]}


def test_lines_of_few_words(spark):
    """Lines drawn from a few, so that runs repeat, overlap and go on in many ways."""
    rng = random.Random(12)
    some = [prose(rng, n) for n in (1, 2, 3, 5, 8, 9, 13, 24, 25, 30)]
    rows = [(k, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: lines_of(r["text"]) for r in linededup.dedup(d).collect()} == by_hand(rows)


def test_fingerprints_are_few(docs):
    """Winnowing selects a part of the grams."""
    import numpy as np

    texts = "\n".join(f"{prose(random.Random(k), 3)}" for k in range(3000)).encode()
    h, _, n, doc = linededup.lines(np.frombuffer(texts, np.uint8), np.array([0, len(texts)]))
    *_, at = linededup.runs(h, n, doc)
    assert len(np.unique(at)) < 0.35 * len(h)


def test_boilerplate_makes_no_family(spark, monkeypatch):
    """Texts that share many words, but are not linked, are not compared in pairs."""
    rng = random.Random(6)
    page = prose(rng, 60)
    rows = [(k, f"{page} {prose(rng, 100)}") for k in range(700)]
    sizes, family = [], ngramjoin._family_of
    monkeypatch.setattr(ngramjoin, "_family_of", lambda e: sizes.append(e.count()) or family(e))
    for links in (True, False):
        got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), links=links).collect()
        assert all(r["doc_id"] == r["component_id"] for r in got)
    assert sizes == [0, 0]


def rows_joined_left(spark, since):
    """The rows that left joins by node made in the executions from `since` on, and the number of the next one."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, made, last = store.executionsList(), 0, since
    for i in range(runs.size()):
        k = runs.apply(i).executionId()
        if k < since:
            continue
        last, nodes, values = max(last, k + 1), store.planGraph(k).allNodes(), store.executionMetrics(k)
        for j in range(nodes.size()):
            if re.search(r"Join \[node#\d+L?\], \[node#\d+L?\], LeftOuter", nodes.apply(j).desc()):
                metrics = nodes.apply(j).metrics()
                got = [values.get(metrics.apply(m).accumulatorId()) for m in range(metrics.size()) if metrics.apply(m).name() == "number of output rows"]
                made += sum(int(v.get().replace(",", "")) for v in got if v.isDefined())
    return made, last


def test_only_families_are_joined(spark, monkeypatch):
    """Where there are families, sets and not their shingles are joined with them: rows follow the documents."""
    monkeypatch.setattr(ngramjoin, "DENSE", 8)
    rng = random.Random(11)
    rows = []
    for k in range(150):  # two long texts that are linked and in no family
        words = prose(rng, 400).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "edit"]))]
    page = prose(rng, 80).split()
    rows += [(1000 + k, " ".join([*page[:-1], f"end{k}"])) for k in range(20)]  # a family
    _, since = rows_joined_left(spark, 0)
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == n_links(rows)
    made, _ = rows_joined_left(spark, since)
    assert 0 < made <= 6 * len(rows)  # joined with their shingles, these were 18,037


class OneBlock:
    """Stands for rows of blocks and runs what is applied to a group on one table, here."""

    def __init__(self, table):
        self.table = table

    def groupBy(self, _):
        return self

    def applyInArrow(self, run, _):
        return run(self.table)


def test_links_of_a_block_are_counted_in_little_memory():
    """Memory follows the sets of a block, not its links: 2,500 short sets, all linked, and 500 linked with none."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, apart = 2500, 500
    sets = [np.sort(np.array([*range(7), 1000 + k], "<u8")) for k in range(n)] + [np.arange(9000 + 9 * k, 9008 + 9 * k).astype("<u8") for k in range(apart)]
    table = pa.table({
        "block": [1] * len(sets), "probe": [True] * len(sets), "cand": [True] * len(sets), "node": range(len(sets)), "comp": range(len(sets)),
        "copies": [1 + k % 3 for k in range(len(sets))], "toks": [s.tobytes() for s in sets],
    })
    tracemalloc.start()
    out = ngramjoin._every_link(OneBlock(table), True).to_pylist()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    total = sum(1 + k % 3 for k in range(n))
    assert {r["a"]: r["b"] for r in out if r["kind"] == ngramjoin.COUNT} == {k: total - 1 - k % 3 for k in range(n)}
    assert {r["a"]: r["b"] for r in out if r["kind"] == ngramjoin.JOINED} == {k: 0 for k in range(1, n)}
    assert peak < 64 << 20  # two numbers for each of the links alone are 50 million bytes, listed twice and sorted


def test_counted_links_of_overlapping_sides():
    """Probes and candidates apart, equal and in part the same: counts as those of listed pairs."""
    import numpy as np

    rng = random.Random(5)
    base = [rng.sample(range(400), 30) for _ in range(4)]
    sets = []
    for _ in range(90):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(30)] = rng.randrange(400, 500)
        sets.append(np.unique(np.array(s, np.uint64)))
    sizes, copies = np.array([len(s) for s in sets]), np.array([rng.randrange(1, 4) for _ in sets])
    some = np.arange(90)
    for comp in (some, some % 7):
        for probes, cands in ((some, some), (some[:40], some[40:]), (some[:60], some[30:])):
            pairs = {(min(a, b), max(a, b)) for a in probes for b in cands if a != b and comp[a] != comp[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
            assert pairs == set(map(tuple, ngramjoin.listed_links(probes, cands, sizes, sets, comp).tolist())) and pairs
            n, label = ngramjoin.counted_links(probes, cands, sizes, sets, comp, copies)
            want = [sum(int(copies[b if a == k else a]) for a, b in pairs if k in (a, b)) for k in range(90)]
            assert n.tolist() == want
            a, b = np.array(sorted(pairs)).T
            assert label.tolist() == ngramjoin.least_joined(90, a, b).tolist()
