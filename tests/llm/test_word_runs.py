from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from syndica.llm import queries, word_runs


def plain_runs(words):
    """Every stretch of a smallest period that no neighbour extends, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # periods rise, so the smallest stays
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def numbered(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_ones(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words = []
        while len(words) < rng.randrange(90):
            part = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 5))]
            words += part * rng.choice([1, 1, 2, 5, 9])
        assert word_runs.runs_of_words(numbered(words)) == plain_runs(words), words


def test_suffixes_are_sorted_with_their_common_prefixes():
    rng = random.Random(9)
    for n in (0, 1, 2, 7, 60, 200):
        words = np.array([rng.randrange(3) for _ in range(n)], np.int64)
        order, lcp = word_runs.sorted_suffixes(words)
        tails = [words[i:].tolist() for i in order]
        assert tails == sorted(tails)
        for k in range(1, n):
            a, b = tails[k - 1], tails[k]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == common


def test_long_runs_take_no_square_of_their_length():
    words = numbered(["a"] * 20_000 + ["b"] + ["c", "d", "e"] * 7_000)
    assert word_runs.runs_of_words(words) == [(0, 20_000, 1), (20_001, 21_000, 3)]


def expected(doc_id, text):
    words = queries.op13_words(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, words):
    """The contract's periodic tails, word by word."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return list(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_tails_are_planted_as_agreed():
    rng = random.Random(3)
    for doc_id in range(2_000):
        words = [str(rng.randrange(50)).encode() for _ in range(rng.randrange(60))]
        assert queries.op13_words(doc_id, words) == planted(doc_id, words)


def test_digests_of_odd_texts(clashing):
    rng = random.Random(5)
    texts = [None, "", "  ", "one", "a a a a a", "a a a a a a", "x " + "la li " * 9 + "y z", "\x1c \x1c \x1c \x1c \x1c \x1c",
             "z " * 5_000, "la li lo la li lo la li lo la li lo lo lo lo lo lo lo lo"]
    texts += [" ".join(rng.choice("pqr") for _ in range(rng.randrange(150))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "k " * 8), (3, "k " * 8), (None, "k k k k k k"), (-10, "u v " * 20)]
    got = word_runs.run_digests(word_runs.find_runs(clashing(*rows), prepare=queries.op13_words))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert word_runs.find_runs(clashing((0, "a")).limit(0)).count() == 0


def test_other_exponents(docs):
    [row] = word_runs.find_runs(docs("a b a b a b c c"), exponent=2, length=2).collect()
    assert [tuple(r) for r in row.runs] == [(0, 6, 2), (6, 2, 1)] and row.collapsed == "a b c"


def test_query_equals_plain_form(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_word_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in rows)
    assert any(r.n_runs for r in got)
