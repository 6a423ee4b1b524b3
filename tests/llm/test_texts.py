"""Licence scans, fill-in-the-middle and importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calorgrid.llm import fim, importance, kernel, licences

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return LETTERS.findall(low(text))


@pytest.mark.parametrize("text", ["", "a", "plain words", "é", "Straße €10 \U0001f600 x", "日本語のテキスト", "a" * 1000 + "é" * 7, "\u0000\U0010ffff"])
def test_boundary_lists(text):
    data = text.encode()
    n, width, lo, hi = fim.boundaries(np.frombuffer(data, np.uint8))
    k = np.arange(n + 1)
    column = lambda b: pa.array([b] * (n + 1), pa.binary())
    got = fim.select(np.full(n + 1, width), column(lo), column(hi), k)
    assert n == len(text) and got.tolist() == [len(text[:i].encode()) for i in k]


def cut(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, out)


@pytest.mark.parametrize("case", ["few", "large groups", "one hash"])
def test_cuts(spark, edge_rows, monkeypatch, case):
    if case == "large groups":
        monkeypatch.setattr(fim, "HOT_ROWS", 2)
    if case == "one hash":  # contents that meet under one hash are still told apart
        keys = fim._keys
        monkeypatch.setattr(fim, "_keys", lambda text: keys(text) | {"__h": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") % 3})
    rows = [(r[0], r[1]) for r in edge_rows] + [(k, t) for k, t in enumerate(["same text here"] * 40 + ["has <S> inside", "ü<é>"] * 20)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr) == sorted((cut(*r) for r in rows), key=repr)
    back = got.select("text", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)


def resampled(docs, target, longest, buckets):
    """weight and score of (doc_id, text) rows, and the ids drawn in order."""
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for doc_id, text in docs:
        f = runs(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, [(r[0], r[4]) for r in enough[: 10 * len(enough) // 100]]


@pytest.mark.parametrize("longest, buckets, size", [(1, 10000, 1 << 22), (3, 97, 1 << 10)])
def test_resampling(spark, docs, edge_rows, monkeypatch, longest, buckets, size):
    monkeypatch.setattr(importance, "SLICE", size)
    rows = [(r[0], r[1]) for r in edge_rows] + [(1000 + r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r[1] for r in rows[30:60]] + [None, ""]
    df, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.ranked(importance.scored(importance.weights(df, goal, longest, buckets))).collect()
    want, drawn = resampled(rows, target, longest, buckets)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in got), key=repr) == sorted(want, key=repr)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_no_target(spark):
    docs = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    row = importance.digest(docs, spark.createDataFrame([], "text string")).first()
    assert row["n_features"] == 40 and row["rank"] is None
    assert row["weight"] == 40 * math.floor(1000 * math.log(10040 / (21 * 10000)))


def found(text, idf):
    """Labels of the templates found in a text and the best score, by plain loops over all relative positions."""
    w, labels, best = words(text), set(), 0.0
    for label, phrases, template in licences.TEMPLATES:
        t = template.split()
        own = sorted(set(t) & set(w), key=lambda x: (-idf[x], x))[: licences.ANCHORS]
        scores = []
        for at in range(-len(t), len(w) + 1):
            votes = sum(any(w[at + k] == a for k in range(len(t)) if t[k] == a and 0 <= at + k < len(w)) for a in own)
            near = lambda k, p, at=at: any(w[i : i + len(p)] == p for i in range(max(0, at + k - licences.SLACK), at + k + licences.SLACK + 1))
            if votes < min(licences.NEEDED, len(set(t))):
                continue
            starts = [next(k for k in range(len(t)) if t[k : k + len(p)] == p) for p in map(str.split, phrases)]
            if all(near(k, p) for k, p in zip(starts, map(str.split, phrases))):
                scores.append(sum(idf[x] for k, x in enumerate(t) if near(k, [x])) / sum(idf[x] for x in t))
        if scores and max(scores) >= licences.LEAST:
            labels.add(label)
            best = max(best, *scores)
    return labels, min(1.0, best)


def test_licences(spark, docs, edge_rows):
    rng = random.Random(3)
    filler = "the of and to in a is that software copy file rights work public general".split()
    rows = [(r[0], r[1] if len(r[1] or "") < 5000 else None) for r in edge_rows]
    for k, (_, _, t) in enumerate(licences.TEMPLATES):
        w = t.split()
        before, after = ([rng.choice(filler) for _ in range(rng.randrange(30))] for _ in range(2))
        rows.append((100 + 4 * k, " ".join([*before, *w, *after]).title()))
        rows.append((101 + 4 * k, "\n# ".join([*before, *w[: len(w) // 2], *after])))  # half of it
        edited = [x for x in w if rng.random() < 0.9]
        rows.append((102 + 4 * k, " ".join([*before, *edited, *after, "x", *w])))
        rng.shuffle(w)
        rows.append((103 + 4 * k, " ".join([*before, *w])))
    rows += [(900, "Released under the MIT License. MIT license; mit-license"), (901, "mit  licenses general public licensee"), (902, None)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r for r in licences.scan(df).collect()}
    vocabulary = {w for _, _, t in licences.TEMPLATES for w in t.split()} | {w for _, p in licences.BASE for w in p.split()}
    count = Counter(w for _, text in rows for w in set(words(text)) & vocabulary)
    idf = {w: math.log((len(rows) + 1) / (count[w] + 1)) + 1 for w in vocabulary}
    marked = 0
    for doc_id, text in rows:
        r, w = got[doc_id, text], words(text)
        places = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for label, p in licences.BASE}
        every = sorted(i for p in places.values() for i in p)
        base = {label for label, p in places.items() if p}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        assert r["base_labels"] == ",".join(sorted(base))
        labels, best = found(text, idf) if len(w) < 400 else (None, None)
        if labels is not None:
            assert r["labels"] == ",".join(sorted(base | labels)), text
            assert r["score"] == pytest.approx(best, abs=1e-9)
            marked += bool(labels)
    assert marked > 40


def test_whole_templates_are_found(spark):
    rows = [(k, f"Some words before. {t}\nand after", label) for k, (label, _, t) in enumerate(licences.TEMPLATES)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert all(r["label"] in r["labels"].split(",") and r["score"] == pytest.approx(1) for r in got)


def test_letter_words():
    texts = ["Été, ÉTÉ x1_y", "", "a", "b c", None, "日本 Aa"]
    codes, distinct, first = kernel.letter_words(*kernel.flat(pa.array(texts, pa.string())))
    got = [distinct[c].as_py() for c in codes.tolist()]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:])] == [words(t) for t in texts]


def test_importance_slices_one_by_one(spark, monkeypatch):
    """A reader takes one slice at a time, however many a task has written, and no group of lists forms all of them."""
    import glob
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    from calorgrid.llm import importance, store

    monkeypatch.setattr(importance, "SLICE", 1 << 8)
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 50}" for j in range(30))) for k in range(40)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = importance.weights(docs, spark.createDataFrame([("w1 w2 w3",)], "text string"))
    plan = made._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert {r["doc_id"]: r["n_features"] for r in made.collect()} == {k: len((t or "").split()) for k, t in rows}
    for path in [p for _, p in store._kept if "/slices-" in p][-1:]:
        groups = [pq.ParquetFile(f).metadata for f in glob.glob(urlparse(path).path + "/*.parquet")]
        assert sum(m.num_rows for m in groups) > 10 and all(m.row_group(k).num_rows == 1 for m in groups for k in range(m.num_row_groups))


def test_importance_gains_in_lists(spark, monkeypatch):
    """The gains of a slice leave a task in lists, whatever batches and held rows divide them."""
    from calorgrid.llm import importance

    rows = [(s, g, (g * 31 + s) % 700 - 350) for s in (5, 1 << 33, (7 << 32) + 1) for g in range(400)]
    df = spark.createDataFrame(rows, "slice long, gram int, gain int").repartition(2)
    for held, most in ((1 << 20, 6), (100, 60)):
        monkeypatch.setattr(importance, "HELD", held)
        got = df.mapInArrow(importance._gathered, "slice long, gram array<int>, gain array<int>").collect()
        assert sorted((r["slice"], g, v) for r in got for g, v in zip(r["gram"], r["gain"])) == sorted(rows)
        assert len(got) <= most


def test_importance_words_written_once(spark):
    from calorgrid.llm import importance

    docs = spark.createDataFrame([(1, "a b a c"), (2, None)], "doc_id long, text string")
    for longest, want in ((1, []), (2, [1] * 3 + [2] * 3)):
        row = importance._slices(docs.coalesce(1), False, longest).first()
        assert row["sizes"] == want and len(row["counts"]) == (3 if longest == 1 else 6)
