"""The pipeline's stages one by one, and the contract's registry."""

from __future__ import annotations

import importlib
import os
import random

import pytest

import corpus_pipeline
from syndica.llm import secret_scan

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


def test_names_of_stages_and_queries():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "substring dedup", "secret scans", "best-fit packing"]
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in found


@pytest.fixture(scope="module")
def prepared(spark, docs):
    """Own documents among the given ones: copies, a shared passage, secrets, odd rows."""
    rng = random.Random(5)
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    words = [w for r in given.where("lang = 'en'").limit(40).collect() for w in r.text.split() if w.isalpha()]
    prose = lambda n: " ".join(" ".join(rng.sample(words, 9)).capitalize() + "." for _ in range(n))
    first, passage = prose(25), prose(8)
    rows = [(10**6, first), (10**6 + 1, first), (10**6 + 2, first.replace(".", ",", 1)),
            (10**6 + 3, prose(10) + " " + passage + " " + prose(10)), (10**6 + 4, prose(9) + " " + passage + " " + prose(9)),
            (10**6 + 5, prose(12) + " password=abcdef123456 " + prose(6)), (None, prose(12)), (10**6 + 6, prose(15))]
    return given.unionByName(docs(*rows)), dict(r for r in rows if r[0])


def test_each_stage_on_what_the_one_before_kept(spark, prepared):
    table, own = prepared
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, table, DATA)
    assert kept.columns == table.columns
    before = {r.doc_id: r for r in kept.collect()}
    assert set(own) | {None} <= set(before)

    alone = stages["SimHash near-dedup"](spark, kept, DATA)
    ids = {r.doc_id for r in alone.collect()}
    assert alone.columns == table.columns and 10**6 + 1 not in ids and 10**6 in ids and None in ids

    short = stages["substring dedup"](spark, alone, DATA)
    texts = {r.doc_id: r for r in short.collect()}
    assert short.columns == table.columns and set(texts) == ids
    assert texts[10**6 + 3].text == own[10**6 + 3] and texts[10**6 + 6].text == own[10**6 + 6]
    assert len(texts[10**6 + 4].text) < len(own[10**6 + 4])
    assert all(r.n_chars == len(r.text) for r in texts.values())

    clean = stages["secret scans"](spark, short, DATA)
    out = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == table.columns and set(out) == ids
    assert corpus_pipeline.MARK in out[10**6 + 5] and "abcdef123456" not in out[10**6 + 5]
    assert all(not secret_scan.base_spans(t) for t in out.values())

    packed = stages["best-fit packing"](spark, clean, DATA).collect()
    assert {r.doc_id for r in packed} == ids
    fills = {}
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 1024 and len(fills) <= 1.02 * sum(fills.values()) / 1024 + 1


def test_stages_with_columns_of_clashing_names(spark, clashing):
    table = clashing("Some words of a text that stands here.", None, "", "password=abcdef1 here", (None, "x"))
    docs = table
    for name in ("_gone", "_doc", "_hash", "_spans", "_c0", "doc_id2"):
        docs = docs.selectExpr("*", f"'other' AS `{name}`")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        made = stage(spark, docs, DATA)
        assert made.columns == [c for c in docs.columns if c != "TEXT"] and made.count() >= 4
        assert {r["_gone"] for r in made.collect()} == {"other"}
    assert corpus_pipeline.STAGES[0][1](spark, docs, DATA).columns == [c for c in docs.columns if c != "TEXT"]
    assert len(corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()) == 5


def test_one_row_of_each_group_stays(spark, docs):
    a, b = "one text of quite a few words that stands in two rows", "another text, with other words in it, twice as well"
    rows = [(1, a), (2, a), (2, b), (3, b.upper()), (5, "t u v w"), (5, "t u v w"), (6, None), (6, None), (7, ""),
            (8, a + " and some more that makes it a text of its own entirely"), (9, "word " * 30_000), (10, "word " * 30_000),
            (11, "T u V w x y"), (11, "t U v W x y"), (None, a), (None, a)]
    kept = corpus_pipeline.near_dedup(spark, docs(*rows), DATA).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    [one] = {t for d, t in got if d == 11}  # either of two texts of one id
    assert one in ("T u V w x y", "t U v W x y")
    want = [(1, a), (2, b), (5, "t u v w"), (6, None), rows[9], rows[10], (11, one), (None, a), (None, a)]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, docs((0, "a")).limit(0), DATA).count() == 0


def test_run_and_an_empty_table(spark, docs, tmp_path):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len(rows) > 50
    docs("x").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
