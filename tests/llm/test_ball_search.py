from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np

from syndica.llm import ball_search, queries

SF = "/root/testdata/sf0.001"


def plain(rows, items, k):
    """All scores, by the formula itself."""
    docs = [(d, Counter(ball_search.terms_of(t))) for d, t in rows]
    n = sum(1 for _, c in docs if c)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            score = 0
            for t in set(ball_search.terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * sum(c.values()) * n // length
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def spark_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    assert ball_search.terms_of("Ab-cD_9 ÄÖ\x7fé, x") == ["ab", "cd", "9", "ÄÖ", "é", "x"]
    assert ball_search.terms_of(None) == ball_search.terms_of(" .,") == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    groups = rng.integers(0, 900, (6, 40)) * (rng.random((6, 40)) < 0.3)
    rows = np.maximum(0, groups[rng.integers(0, 6, 500)] + rng.integers(-3, 4, (500, 40))).astype(float)
    tree = ball_search.Tree(rows)
    for _ in range(30):
        own = np.sort(rng.choice(40, 6, replace=False))
        weights = rng.integers(1, 9_000, 6).astype(float)
        scores = rows[:, own] @ weights
        for bound, (a, b) in zip(tree.bounds(own, weights), tree.stretch):
            assert scores[tree.order[a:b]].max() <= bound
        top = np.sort(scores)[-10]
        seen = {}
        for where, found in tree.best(own, weights, lambda: top):
            seen |= dict(zip(where.tolist(), found.tolist()))
        assert all(seen[i] == scores[i] for i in seen)
        assert set(np.nonzero(scores >= top)[0].tolist()) <= set(seen)
    assert len(seen) < 400  # subtrees are left out


def test_equal_to_all_scores(spark, clashing, monkeypatch):
    monkeypatch.setattr(ball_search, "TREE_DOCS", 40)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["ä", "Ü9"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " .. "), (None, "w1 w2 w3"), (950, texts[7]),
                                     (951, texts[7].upper()), (903, "w5 " * 30_000), (7, texts[7]), (7, texts[7])]
    items = [(1, "w1 W2 w2 w59"), (2, "nothing"), (3, None), (4, ""), (5, texts[7]), (5, "w3"), (6, "ä Ü9 w4")]
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS rank", "'x' AS doc_id")
    for k in (3, 50):
        got = spark_rows(ball_search.rank_documents(clashing(*rows).repartition(5), table, k))
        assert got == plain(rows, items, k)
    assert ball_search.rank_documents(clashing((0, "w1")).limit(0), table).count() == 0
    assert ball_search.rank_documents(clashing((0, "w1")), table.limit(0)).count() == 0
    assert ball_search.rank_documents(clashing((0, ".")), table).count() == 0


def test_queries_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ball_search, "QUERY_TERMS", 8)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=9))) for i in range(60)]
    items = [(i, " ".join(rng.choices("abcdefghxyz", k=4))) for i in range(12)]
    got = ball_search.rank_documents(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string"), 5)
    assert spark_rows(got) == plain(rows, items, 5)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op12_ball_search(spark, SF).select("item_id", "rank", "doc_id", "score")
    assert spark_rows(got) == sorted(con.execute(queries.ORACLES["op12_ball_search"]).fetchall(), key=str)
