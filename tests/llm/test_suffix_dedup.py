from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from syndica.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.01"


def plain(rows, length):
    """Every window of every text, counted."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    windows = Counter(hash(b[i:i + length]) for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if windows[hash(b[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(map(tuple, suffix_dedup.repeat_digests(df).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(3, 25))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else word() * rng.randrange(1, 4))
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "x"), (503, "ab" * 300), (504, "a" * 90), (505, "a" * 400), (506, passages[0]),
             (506, passages[0]), (506, passages[1] + "!"), (None, passages[2] + passages[3]), (507, rows[5][1])]
    edited = " ".join(word() for _ in range(60))
    rows += [(600 + i, edited[:9 * i] + "#" + str(i) + edited[9 * i:]) for i in range(30)]
    return rows


@pytest.mark.parametrize("length, anchor, contexts", [(20, 10, 2048), (20, 10, 3), (33, 7, 2048), (50, 40, 5)])
def test_equal_to_all_windows(clashing, length, anchor, contexts):
    rows = texts(length + contexts)
    df = clashing(*rows).repartition(3)
    got = digests(suffix_dedup.find_repeats(df, length=length, anchor=anchor, max_contexts=contexts))
    assert got == plain(rows, length)


def test_long_texts_in_pieces_and_kept_bytes(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    rng = random.Random(8)
    rows = texts(3) + [(900, "".join(rng.choices("abc", k=3_000)))]
    rows += [(901, "--" + rows[-1][1][700:1_900] + "=="), (902, "é" * 150)]
    finder = suffix_dedup.Anchors(40, 20)
    for _, text in rows:
        body = (text or "").encode()
        [(first, windows, _)] = finder.of([body])
        covered = [i for f, n in zip(first.tolist(), windows.tolist()) for i in range(f, f + n)]
        assert covered == list(range(max(0, len(body) - 39)))
    found = suffix_dedup.find_repeats(docs(*rows), length=40, with_kept=True)
    assert digests(found) == plain(rows, 40)
    for r in found.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert suffix_dedup.find_repeats(docs((0, "a")).limit(0)).count() == 0


def test_places_in_a_shard():
    a, b = b"0123456789" * 3, b"xx0123456789yy"
    places = suffix_dedup.repeated_places([a, b, b"zz"], 10)
    assert [p.tolist() for p in places] == [list(range(21)), [2], []]
    same = suffix_dedup.repeated_places([b"-abcde", b"fghijk", b"+abcde", b"fghijk"], 6)
    assert [p.tolist() for p in same] == [[], [0], [], [0]]


def test_query_equals_plain_form(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_suffix_dedup(spark, SF).collect()), key=str) == plain(rows, 200)
