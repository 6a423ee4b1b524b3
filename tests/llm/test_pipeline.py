"""The corpus pipeline, stage by stage, each on its own input."""

import corpus_pipeline
from calorgrid.llm import linededup, mixing
from tests.llm.conftest import SCHEMA
from tests.llm.test_groups import by_hand, groups, lines_of


def test_stages(spark, docs, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near-duplicates", "mixing", "pieces"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    start, spoken, cleaned, single, mixed = ([(r["doc_id"], r["text"], r["source"]) for r in t.collect()] for t in tables[:-1])

    assert {k for k, _, _ in spoken} <= {k for k, _, _ in start} and len(spoken) > 0.8 * len(start)
    lines = by_hand([r[:2] for r in spoken])
    assert {k: lines_of(t) for k, t, _ in cleaned} == {k: x for k, x in lines.items() if x}
    assert sorted(r[0] for r in single) == sorted(k for k, _, c in groups([r[:2] for r in cleaned]) if k == c)
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(tables[3]).collect()}
    assert sorted(r[0] for r in mixed) == sorted(k for k, n in copies.items() for _ in range(n))
    pieces = tables[-1].collect()
    assert len(pieces) == len(mixed) and all(r["lossless"] for r in pieces)
    assert linededup.GUARANTEE == 25 > linededup.GRAM_WORDS


def test_stage_edges(spark, edge, clashing, empty, sf_dir):
    """Every stage on nulls, empty and long texts and repeated rows; columns of clashing names change nothing, and an
    empty table stays one."""
    for name, stage in corpus_pipeline.STAGES:
        got = [stage(spark, d, sf_dir) for d in (edge, clashing, empty)]
        assert got[0].columns == got[1].columns and set(got[0].columns) >= set(edge.columns), name
        plain, extra, none = ([repr(tuple(r)) for r in g.collect()] for g in got)
        assert sorted(plain) == sorted(extra) and plain and not none, name


def test_ids_with_two_texts(spark):
    """Of each group one row stays, though ids repeat: the copy under id 8 of the text of id 3 goes, its namesake not."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(words)
    near = " ".join([*words[:-1], "other"])
    rows = [(3, b), (8, a), (8, near), (9, a + " end"), (10, near), (11, ""), (11, " "), (11, ""), (12, "c " + a[:20]), (12, "c " + a[:20])]
    rows += [(20, "x " + " ".join(f"x{i}" for i in range(60))), (20, "y " + " ".join(f"x{i}" for i in range(60)))]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], SCHEMA)
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert kept[:-1] == sorted([(3, b), (8, a), (11, ""), (11, " "), (12, "c " + a[:20])])
    assert kept[-1][0] == 20 and len(kept) == 6
