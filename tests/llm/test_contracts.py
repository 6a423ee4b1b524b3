"""The numbered operators against SQL, libraries and brute force, over the tables and over edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from calorgrid.llm import fim, importance, langid, licences, linededup, lineclean, mixing, ngramjoin, ordminhash, queries, rans, spsample, store, tokcount, warc
from tests.compare import connect, same
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


@pytest.fixture(scope="module")
def runs(byte_bpe, piece_bpe):
    return {
        "op2": lambda d: rans.digest(d, byte_bpe),
        "op3": lambda d: lineclean.clean(d),
        "op4": langid.digest,
        "op5": linededup.dedup,
        "op6": lambda d: tokcount.count(d, byte_bpe),
        "op7": ngramjoin.join,
        "op8": ordminhash.digest,
        "op9": mixing.digest,
        "op9-mix": mixing.mix,
        "op10": lambda d: spsample.decode(spsample.encode(d, piece_bpe), piece_bpe),
        "op11": licences.scan,
        "op12": fim.transform,
        "op13": lambda d: importance.digest(d, d),
    }


OPS = [f"op{n}" for n in range(2, 14)]


@pytest.mark.parametrize("op", [*OPS, "op9-mix"])
def test_edges(runs, edge, clashing, edge_rows, op):
    """Every row stays, and columns of clashing names change nothing."""
    plain, extra = runs[op](edge), runs[op](clashing)
    got = [tuple(r) for r in plain.collect()]
    again = [tuple(r) for r in extra.select(*[f"`{c}`" for c in plain.columns]).collect()]
    assert op == "op9-mix" or len(got) == len(edge_rows)
    assert sorted(got, key=repr) == sorted(again, key=repr)


@pytest.mark.parametrize("op", [*OPS, "op9-mix"])
def test_empty(runs, empty, op):
    assert runs[op](empty).count() == 0


def test_junk_lines(spark):
    """Precision and recall on planted lines: noise, menus, stutter and furniture among prose of four languages."""
    import random

    rng = random.Random(11)
    words = {"en": "the river of stone and market light", "de": "der Fluss und die große Brücke über", "fr": "la rivière où le marché était déjà", "es": "el río y la canción del año más"}
    furniture = {"en": ["Read more", "All rights reserved.", "Home | News | Contact"], "de": ["Weiterlesen", "Alle Rechte vorbehalten.", "Startseite | Kontakt | Suche"], "fr": ["Lire la suite", "Tous droits réservés.", "Accueil > Connexion > Recherche"], "es": ["Leer más", "Todos los derechos reservados.", "Inicio | Buscar | Contacto"]}
    rows = []
    for lang, w in words.items():
        w = w.split()
        prose = lambda n, w=w: " ".join(rng.choice(w) + rng.choice(["", "s", "en", "er", "a", "o", "ung", "ly"]) for _ in range(n))
        for _ in range(60):
            rows += [(prose(rng.randrange(3, 40)).capitalize() + rng.choice(".!?"), False), (prose(rng.randrange(1, 6)).title(), False)]
            rows += [(" ".join(rng.choice(w) + rng.choice(["###", "***", "%%%", "&&&"]) for _ in range(rng.randrange(3, 20))), True)]
            rows += [(" | ".join(rng.choice(w) for _ in range(rng.randrange(4, 20))) + " |", True), (" ".join([rng.choice(w)] * rng.randrange(8, 60)), True)]
            rows += [(rng.choice(furniture[lang]), True), (prose(rng.randrange(20, 60)), True)]
    df = spark.createDataFrame(rows, "line string, junk boolean")
    got = df.select("junk", lineclean.fails(df["line"]).alias("bad")).collect()
    hit = sum(r["junk"] and r["bad"] for r in got)
    assert hit >= 0.98 * sum(r["junk"] for r in got) and hit >= 0.98 * sum(r["bad"] for r in got)


def test_too_many_sources(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(Exception, match="more than 2 sources"):
        mixing.digest(docs).collect()


def test_warc_edges(spark):
    long = "x" * 2000
    rows = [(1, "http://a/\r\nb", long), (2, None, long), (3, "http://c", None), (None, "http://d", "ü\r\n\r\nWARC/1.1"), (5, "http://e", "s"), (6, "http://e", "s"), (7, "http://f", "€" * 400), (7, "http://f", "€" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = store.new_path(spark, "warc-test")
    warc.write(pages, path)
    got = sorted(map(tuple, warc.digests(warc.assemble(warc.read(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    for k, _, html in rows:
        body = (html or "").encode()
        assert by[k][1:3] == (len(body), hashlib.sha1(body).hexdigest())
    assert by[1][3:] == ("revisit", 2) and by[2][3:] == ("response", None)
    assert all(by[k][3] == "response" for k in (3, None, 5, 6))
    empty = store.new_path(spark, "warc-test")
    warc.write(pages.where("false"), empty)
    assert warc.assemble(warc.read(spark, empty)).count() == 0


def test_warc_members(spark):
    """Each record is a gzip member; files roll by bytes; a page of 50 MB comes through; repeated ids and rows too."""
    import glob
    import gzip

    rng = np.random.default_rng(0)
    big = rng.integers(97, 123, 50_000_000, dtype=np.uint8).tobytes().decode()
    rows = [(k, f"http://h/{k}", f"page {k} " * (k * 3)) for k in range(300)] + [(1000, "http://big", big), (7, "http://h/x", "other"), (8, "http://h/8", "page 8 " * 24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = store.new_path(spark, "warc-test")
    warc.write(pages, path, file_bytes=4000)
    files = glob.glob(path.removeprefix("file:") + "/*.txt")
    assert len(files) > 10
    small = min((open(f, "rb").read() for f in files), key=len)
    assert gzip.decompress(small) == b"".join(map(bytes, warc._inflated(small)))
    starts, left = 0, small
    while left:
        z = zlib.decompressobj(31)
        starts += z.decompress(left).startswith(b"WARC/1.1\r\n")
        left = z.unused_data
    assert starts == sum(1 for _ in warc.parse(small))
    captures = warc.assemble(warc.read(spark, path)).collect()
    got = sorted((r["response"]["payload_bytes"], r["response"]["payload_digest"], len(r["metadata"])) for r in captures)
    assert got == sorted((len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), 1) for _, _, t in rows)
    assert all(r["request"]["target_uri"].startswith("http://") for r in captures)
    with pytest.raises(ValueError):
        list(warc.parse(small[: len(small) // 2]))


def _encoded(byte_bpe, rows):
    t = Tokenizer.from_file(byte_bpe)
    return [t.encode(r or "", add_special_tokens=False).ids for r in rows]


def test_token_files(spark, docs, byte_bpe):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for r, ids in zip(rows, _encoded(byte_bpe, [r["text"] for r in rows])):
        ids = [*ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rans.digest(docs, byte_bpe).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_token_file_detects_damage(byte_bpe):
    content = b"".join(rans.group([1, 2], np.array([3, 5]), np.arange(8) % 5))
    assert [k for k, _ in rans.frames(content)] == [b"TABL", b"DOCS", b"BLCK"]
    for at in range(17, len(content), 29):
        broken = bytearray(content)
        broken[at] ^= 1
        with pytest.raises(Exception):
            list(rans.frames(bytes(broken)))


def test_stretches_decode_alone(monkeypatch):
    """Every stretch between two checkpoints gives its ids, and notices wrong ones."""
    monkeypatch.setattr(rans, "CHECKPOINT", 7)
    rng = np.random.default_rng(1)
    for n in (1, 5, 16, 17, 3000, 70001):
        ids = (rng.zipf(1.3, n) % 500).astype(np.uint32)
        coder = rans.Coder(*rans.frequencies(ids))
        found = list(rans.stretches(coder.encode(ids)))
        assert [s.first for s in found] == np.cumsum([0, *[s.n for s in found]])[:-1].tolist()
        for s in reversed(found):
            assert (coder.decode(s) == ids[s.first : s.first + s.n]).all()
        with pytest.raises(ValueError):
            coder.decode(found[0]._replace(crc=found[0].crc ^ 1))


def test_checksums_combine():
    a, b = b"some bytes", b"and some more of them" * 50
    assert rans.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert rans.combine(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_token_files_of_several_ranges(spark, byte_bpe):
    """Several files per partition, several stretches per file, documents over several stretches."""
    rows = [(k, f"{k} words " * (1 + k % 7 * 40 + 9000 * (k == 12))) for k in range(60)] + [(None, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = store.new_path(spark, "rans-test")
    rans.write(docs, path, byte_bpe, group_ids=5000, block=500)
    assert rans.units(spark, path).count() > 60
    got = {r["key"]: r for r in rans.with_starts(rans.read(spark, path)).collect()}
    start = 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*_encoded(byte_bpe, [text])[0], 0], "<u4").tobytes()
        r = got[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_language(docs):
    got = {r["doc_id"]: r for r in langid.digest(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = seen = 0
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert g["lang_pred"] == "und"
        elif r["lang"] and r["lang"] != "und" and g["held_out"]:
            seen, right = seen + 1, right + (g["lang_pred"] == r["lang"])
    assert seen and right >= 0.9 * seen


def test_marks_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "an apple a day", "en"), (2, "un jour de pluie", "fr"), (3, "the other day", "en"), (4, "une autre pluie", "fr")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = ["\u0301", "\u0301 12", "a\u0301", "", None, "7 % !"]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(got)] == [True, True, False, True, True, True]


def test_every_language_is_learned(spark):
    """Beyond 64 languages none is dropped."""
    words = ["".join(chr(0x4E00 + 97 * k + i) for i in range(4)) for k in range(70)]
    rows = [(40 * k + i, " ".join([words[k]] * 5), f"l{k:02}") for k in range(70) for i in range(40 - k // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 70 and model.weights.size <= langid.CELLS
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(docs, model).collect())


def test_language_scores_by_hand(docs):
    """Posteriors from the weights by a plain loop over the n-grams of a text."""
    model = langid.fit(docs)
    rows = docs.where("text is not null").limit(20).collect()
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    low, _ = langid._letters()
    for r in rows:
        chars = [int(low[ord(c)]) for c in r["text"]]
        total = model.prior.copy()
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                part = chars[i : i + n]
                if all(c == 0x20 for c in part):
                    continue
                code = 0
                for c in part:
                    code = (code * 0x110000 + c) & (1 << 64) - 1
                h = (code + n * (0xA0761D6478BD642F & (1 << 62) - 1)) & (1 << 64) - 1
                bucket = int(langid.kernel.mix(np.array([h], np.uint64))[0]) >> 47
                total = total + model.weights[bucket]
        if got[r["doc_id"]]["lang_pred"] != "und":
            assert got[r["doc_id"]]["lang_pred"] == model.langs[int(total.argmax())]
            assert abs(got[r["doc_id"]]["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-3


def test_token_counts(docs, edge, byte_bpe):
    for table in (docs, edge):
        rows = tokcount.count(table, byte_bpe).select("text", "n_bytes", "n_tokens", "over_limit").collect()
        for r, ids in zip(rows, _encoded(byte_bpe, [r["text"] for r in rows])):
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), len(ids), len(ids) > 512)


def test_prefix_counts(spark, byte_bpe):
    texts = ["The quick brown fox, 1234 it's they'll", "  two  spaces\n\n tab\t end ", "naïve Ünïcödé — 日本語 текст 😀", "aaaaaaaaaaaaaaaa bbbb'sss", "x <|endoftext|> y"]
    got = tokcount.count(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), byte_bpe).collect()
    for r in got:
        for k in range(len(r["text"]) + 1):
            if 0 <= r["text"].find("<|") < k < r["text"].find("|>") + 2:
                continue  # inside the string of a special token
            assert tokcount.count_at(r["prefix_deltas"], k) == len(_encoded(byte_bpe, [r["text"][:k]])[0]), (r["text"], k)


def test_fingerprints(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in ordminhash.digest(docs).collect()}
    assert len(got) == len(rows)
    seen = {}
    for i, r in enumerate(rows):
        text, after = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["near_edited"] == ordminhash.likeness(ordminhash.signature(text), ordminhash.signature(edited))
        assert seen.setdefault(text, g["fingerprint"]) == g["fingerprint"]
        assert g["near_next"] == ordminhash.likeness(ordminhash.signature(text), ordminhash.signature(after))


def test_signature_by_hand():
    """The components of a signature by sorting all numbered k-mers."""
    text = "the cat sat on the mat and the cat sat on the hat " * 3
    h = ordminhash.kmers(text)
    h2 = ordminhash.numbered(h)
    assert len(set(h2.tolist())) == len(h2)
    sig = ordminhash.signature(text)
    for s in range(ordminhash.SKETCHES):
        v = (h2 ^ ordminhash._SALT[s]) * ordminhash._ODD[s]
        places = sorted(np.argsort(v, kind="stable")[: ordminhash.TUPLE].tolist())
        out = np.zeros(1, np.uint64)
        for j, p in enumerate(places):
            out = ordminhash.kernel.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[p : p + 1] + np.uint64(j + 1))
        assert sig[s] == max(int(out[0]) >> 48, 1)


def test_mixing(spark, docs):
    rows = mixing.digest(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by[source[r["doc_id"]]] = (r["target"], r["source_size"])
    assert all(target <= 3 * size + 1e-6 for target, size in by.values())
    assert abs(sum(t for t, _ in by.values()) - sum(r["size"] for r in rows)) < 1e-3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digest(docs).collect()))
    assert mixing.mix(docs).agg({"n_chars": "count"}).first()[0] == mixing.rates(docs).agg({"copies": "sum"}).first()[0]


def test_pieces_lossless(docs, edge, piece_bpe):
    for table in (docs, edge):
        for r in spsample.decode(spsample.encode(table, piece_bpe), piece_bpe).select("text", "piece_ids", "decoded").collect():
            assert r["decoded"] == (r["text"] or "")
        twice, once = (sorted(map(repr, d.select("doc_id", "piece_ids", "decoded").collect())) for d in (spsample.decode(spsample.encode(table, piece_bpe), piece_bpe), spsample.encode(table, piece_bpe, decoded="decoded")))
        assert once == twice


def test_query_holds_whole_segmentations(spark, docs, sf_dir, piece_bpe):
    """The registered query gives all ids, beyond the first 64 too."""
    want = {r["doc_id"]: r["piece_ids"] for r in spsample.encode(docs, piece_bpe).select("doc_id", "piece_ids").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_sentencepiece_sampling"](spark, sf_dir).collect()}
    assert max(map(len, want.values())) > 64
    assert {k: r["piece_ids"] for k, r in got.items()} == want
    assert all(r["n_pieces"] == len(r["piece_ids"]) and r["lossless"] for r in got.values())


def test_sampled_shares(spark, piece_bpe):
    """Samples of a word come as often as exp(theta * score) says, over all its segmentations."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
    word, theta = "▁the", 1e-3
    usable = {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    floor = min(s for _, s in usable.values() if s > -1e8)

    def ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in usable and (usable[rest[:k]][1] > -1e8 or k == 1):
                i, s = usable[rest[:k]]
                for tail, t in ways(rest[k:]):
                    yield (i, *tail), max(s, floor) + t

    found = {ids: np.exp(theta * s) for ids, s in ways(word)}
    total = sum(found.values())
    n = 4000
    docs = spark.range(n).selectExpr("id AS doc_id", "'the' AS text")
    got = {}
    for r in spsample.encode(docs, piece_bpe, theta=theta).select("piece_ids").collect():
        got[tuple(r[0])] = got.get(tuple(r[0]), 0) + 1
    assert set(got) <= set(found)
    for ids, p in found.items():
        p /= total
        assert abs(got.get(ids, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_same_key_same_sample(spark, docs, piece_bpe):
    a = spsample.encode(docs.select("doc_id", "text"), piece_bpe).repartition(3).collect()
    b = spsample.encode(docs.select("doc_id", "text").repartition(7), piece_bpe).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    assert SCHEMA["doc_id"].dataType == docs.schema["doc_id"].dataType
