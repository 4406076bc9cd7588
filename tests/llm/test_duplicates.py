"""Near duplicates, vectors and passages against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from syndica.llm import caps, passages, simhash, topk
from syndica.llm.common import connected_components, sliced_udf, smallest_reached
from syndica.session import shuffles_removed

VECTORS = "vec_id bigint, embedding array<float>, label int"


def _components(n, linked):
    return smallest_reached(n, ((i, j) for i in range(n) for j in range(i) if linked(i, j)))


def _slow_fingerprint(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, clashing):
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    texts = [None, "", " \n\t", "One", "one", "two words", "Two  WORDS\x0b", "É a b c", " x"]
    texts += [" ".join(base), " ".join(base).upper()]
    for _ in range(25):
        changed = list(base)
        changed[rng.randrange(400)] = "changed"
        texts.append(" ".join(changed))
    texts += ["longer text " * 3000, (None, "no id")]
    got = simhash.near_duplicates(clashing(*texts), max_list=4).collect()
    plain = {i: t for i, t in enumerate(texts) if not isinstance(t, tuple)}
    prints = {i: _slow_fingerprint(t or "") for i, t in plain.items()}
    roots = _components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {
        i: (f"{prints[i]:016x}", roots[i]) for i in prints}
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [
        (f"{_slow_fingerprint('no id'):016x}", None)]
    assert simhash.near_duplicates(clashing("x").limit(0)).collect() == []


@pytest.mark.parametrize("max_list", [4, 1000])
def test_links_of_dense_fingerprints(spark, max_list):
    rng = random.Random(5)
    base, made = rng.getrandbits(64), set()
    for _ in range(250):
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        made.add(x)
    made = sorted(made | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), max_list)
    found = {r.node: r.component for r in connected_components(links).collect()}
    roots = _components(len(made), lambda i, j: (made[i] ^ made[j]).bit_count() <= 2)
    want = {}
    for x, root in zip(signed, roots):
        want.setdefault(root, []).append(x)
    got = {}
    for x in signed:
        got.setdefault(found.get(x, x), []).append(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1200)]
    rows = [*chain, *star, (5, 5), (None, 3), (7, None), (61 + 500, 62 + 500)]
    random.Random(2).shuffle(rows)
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1200)} == {1000}
    assert got[562] == got[561] == 561 and len(got) == 61 + 200 + 2
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def _vectors(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("key", "rep", "size", "filter", "node", "links", "score", "rank", "block"):
        df = df.selectExpr("*", f"'other' AS `{name}`")
    return df.repartition(5)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32).tolist(), 0) for i in range(300)]
    centre = rng.standard_normal(32)
    rows += [(300 + i, (centre + rng.standard_normal(32) * 0.1).tolist(), 1) for i in range(80)]
    rows += [(400 + i, centre.tolist(), 1) for i in range(40)]
    rows += [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] * 32, 0), (503, [None] + [1.0] * 31, 0),
             (504, [float("inf")] * 32, 0), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 0), (507, [], 0)]
    return rows


def test_cap_filters(spark, vectors):
    got = {r.vec_id: r for r in caps.near_vectors(_vectors(spark, vectors), recall=0.999, max_list=16).collect()}
    assert len(got) == len(vectors)
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in vectors if i < 500 or i in (505, 506)}
    ids = sorted(good)
    unit = {i: good[i] / np.linalg.norm(good[i]) for i in ids}
    near = {i: {j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in ids}
    roots = _components(len(ids), lambda a, b: ids[b] in near[ids[a]])
    found = sum(got[i].n_links for i in ids)
    want = sum(len(v) for v in near.values())
    assert 0.98 * want <= found <= want
    assert all(got[i].n_links <= len(near[i]) for i in ids)
    wrong = sum(got[i].component_id != ids[roots[k]] for k, i in enumerate(ids))
    assert wrong <= 2 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for i in (500, 501, 502, 503, 504, 507):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert caps.near_vectors(_vectors(spark, vectors).limit(0)).collect() == []


def test_links_of_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [2e-200, 2e-200]), (3, [1e200, 1e200]), (4, [1e200, -1e200]), (5, [5e-324, 0.0]),
            (6, [1.0, 0.0]), (7, [0.0, 0.0])]
    found = caps.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_lists_are_moved_in_slices(spark, vectors, monkeypatch):
    """The same rows as in one piece, but no slice of the lists is over its size."""
    whole = sorted(map(tuple, caps.near_vectors(_vectors(spark, vectors), max_list=64).collect()), key=str)
    dealt, moved = caps._dealt, []

    def spy(entries, chunked, part, of):
        rows = dealt(entries, chunked, part, of)
        moved.append(rows.count())
        return rows

    monkeypatch.setattr(caps, "_dealt", spy)
    got = caps.near_vectors(_vectors(spark, vectors), max_list=64, slice_rows=3000)
    assert sorted(map(tuple, got.collect()), key=str) == whole
    assert len(moved) > 3 and max(moved) <= 3000 + 500  # lists of one member are not counted


def test_slices_of_a_hot_list(spark):
    """A list over the size of a slice is taken in parts by its chunks, and every two members meet in one of them."""
    counts = spark.createDataFrame([(5, 5, 3, 1), (6, 6, 40, 10), (9, 9, 2, 1)], "filter long, first long, members long, chunks int")
    slices = caps._slices(counts, 100)
    assert slices == [(0, 6, 0, 1), *[(6, 9, part, 4) for part in range(4)], (9, 9 + (1 << 40), 0, 1)]
    entries = spark.range(40).selectExpr("6L AS filter", "id AS rep", "1L AS size", "binary('k') AS key")
    chunked = spark.createDataFrame([(6, 10)], "_filter long, _chunks int")
    met, moved = set(), []
    for _, _, part, parts in slices[1:5]:
        rows = caps._dealt(entries, chunked, part, parts).collect()
        moved.append(len(rows))
        met |= {(a.rep, b.rep) for a in rows for b in rows if (a.i, a.j) == (b.i, b.j) and a.rep < b.rep}
    assert len(met) == 40 * 39 // 2 and sum(moved) == 400


def test_decoding_a_range_of_filters():
    code = caps.CapFilters(12, 300_000)
    assert len(code.codes) == 3
    x = np.random.default_rng(5).standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = list(zip(*code.decode(x)))
    for low, high in ((0, 1), (0, 7777), (7777, 60_001), (60_001, None), (99, 99)):
        want = [(r, f) for r, f in every if low <= f and (high is None or f < high)]
        assert list(zip(*code.decode(x, low, high))) == want


def test_shuffle_files_of_a_write_are_removed(spark, tmp_path):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    with shuffles_removed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "rows"))
    deadline = time.monotonic() + 20
    while files() > before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert files() <= before


def test_recall_at_the_threshold_itself():
    code = caps.CapFilters(64, 5000)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((2000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert len({r for r, _ in code._common(x, y)}) >= 0.95 * 2000


def test_list_decoding_gives_all_filters_exceeded():
    code = caps.CapFilters(12, 300)
    x = np.random.default_rng(1).standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.rotation
    scores = [turned[:, a:b] @ c.T for a, b, c in zip(code.cuts[:-1], code.cuts[1:], code.codes)]
    assert len(scores) == 2
    every = scores[0][:, :, None] + scores[1][:, None, :]
    rows, one, two = np.nonzero(every >= code.threshold)
    assert sorted(zip(rows, one * code.words + two)) == sorted(zip(*code.decode(x)))


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, vectors, block):
    vectors = [*vectors, (600, vectors[0][1], 0), (600, vectors[0][1], 0), (None, vectors[0][1], 0)]
    got = topk.top_k(_vectors(spark, vectors), F.col("vec_id") % 20 == 0, k=7, block=block).collect()
    good = [(i, np.floor(64 * np.array(np.array(v, np.float32), float))) for i, v, _ in vectors
            if i is not None and (i < 500 or i in (505, 506, 507, 600))]
    pad = np.array([np.pad(v, (0, 32 - len(v))) for _, v in good])
    want = []
    for k, (i, _) in enumerate(good):
        if i % 20 == 0:
            scores = pad @ pad[k]
            order = sorted((-int(s), j) for (j, _), s in zip(good, scores) if j != i)[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    key = lambda r: (r[0], r[1], r[3], r[2])
    once = [r for r in want if r[0] != 600]
    assert sorted(map(tuple, (r for r in got if r.query_id != 600)), key=key) == sorted(once, key=key)
    assert topk.top_k(_vectors(spark, vectors).limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_of_repeated_queries(spark, vectors, block):
    """Copies of a query, and rows of its id with another vector, are ranked each by itself."""
    vectors = [*vectors[:100], (600, vectors[0][1], 0), (600, vectors[0][1], 0), (600, vectors[1][1], 0)]
    got = topk.top_k(_vectors(spark, vectors), F.col("vec_id") == 600, k=7, block=block).collect()
    whole = [(i, np.floor(64 * np.array(np.array(v, np.float32), float))) for i, v, _ in vectors]
    want = []
    for _, q in whole[-3:]:
        order = sorted((-int(q @ v), j) for j, v in whole if j != 600)[:7]
        want += [(600, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(0, [1e7, 3e6], 0), (1, [3e6, -1e7], 0), (3, [1e7, 1.0], 0)]
    got = topk.top_k(_vectors(spark, rows), F.col("vec_id") == 0).collect()
    whole = {i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for i, v, _ in rows}
    want = sorted(((sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (1, 3)), key=lambda p: (-p[0], p[1]))
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(_vectors(spark, [(0, [1e20], 0)]), F.col("vec_id") == 0).collect()


def _prose(rng, n, names=400):
    return " ".join(f"w{rng.randrange(names)}" + rng.choice(["", "", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Own texts, some of which hold one of two passages in the middle of a line."""
    rng = random.Random(11)
    shared = [_prose(rng, 70, 10**6) + ".", _prose(rng, 55, 10**6) + "."]
    rows, holds = [], {}
    for i in range(120):
        text = _prose(rng, rng.randrange(5, 200), 10**6)
        if i % 4 == 0:
            which = (i // 4) % 2
            text += " " + shared[which] + " " + _prose(rng, 30, 10**6)
            holds[i] = which
        rows.append((i, text.replace(". ", ".\n", 1)))
    return rows, holds, shared


def test_repeats_inside_other_text(spark, clashing, corpus):
    rows, holds, shared = corpus
    rows = [*rows, (200, None), (201, ""), (None, rows[0][1]), (202, "Released under the MIT License.\n" * 3),
            (203, "Released under the MIT License. And more."), rows[4]]
    found = passages.find_repeats(clashing(*rows)).collect()
    assert {r.doc_id for r in found} == set(holds)
    texts = dict(r for r in rows if r[0] is not None)
    for r in found:
        words = shared[holds[r.doc_id]]
        assert texts[r.doc_id][r.start:r.end].split() and r.words >= 25
        inside = " ".join(texts[r.doc_id][r.start:r.end].split())
        assert inside in " ".join(words.split()) and len(inside) > 0.5 * len(words)
        assert r.first_doc == min(i for i in holds if holds[i] == holds[r.doc_id])
        assert r.kept == (r.doc_id == r.first_doc)
    assert passages.find_repeats(clashing("x").limit(0)).collect() == []


def test_removal_keeps_the_first_and_all_else(spark, docs, corpus):
    rows, holds, shared = corpus
    rows = [*rows, (200, None), (201, ""), (None, rows[0][1])]
    df = docs(*rows)
    got = passages.remove_repeats(df)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert len(texts) == len(rows)
    for i, text in rows:
        if i in holds and i != min(j for j in holds if holds[j] == holds[i]):
            assert len(texts[i]) < len(text) and texts[i].split()[-5:] == text.split()[-5:]
        else:
            assert texts[i] == text


def test_paragraphs_of_several_texts():
    """Texts taken apart together have the paragraphs they have alone."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["end.", "\n", "\u3000x", "\U0001f600"]
    texts = ["", " \n ", "too short"] + [" ".join(rng.choices(words, k=rng.randrange(400))) for _ in range(40)]
    found = passages._paragraphs_of(texts, 3, 6)
    got = list(zip(*[c.tolist() for c in found[:8]]))
    minima = list(zip(*[m.tolist() for m in found[8]]))
    alone, alone_minima = [], []
    for i, text in enumerate(texts):
        one = passages.paragraphs(text, 3, 6)
        if one is not None:
            alone += [(i, n, *row) for n, row in enumerate(zip(*[c.tolist() for c in one[:6]]))]
            alone_minima += list(zip(*[m.tolist() for m in one[6]]))
    assert got == alone and minima == alone_minima and passages._paragraphs_of(["", "a b"], 3, 6) is None
    groups = list(passages._groups(["x" * passages.GROUP, "a", "b", "y" * passages.GROUP, ""]))
    assert groups == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_keys_and_shingles_of_equal_paragraphs_once(spark, docs):
    """A paragraph in many texts of a task has its keys and shingles in one row, and links as before."""
    same = "one two three four five six seven eight nine ten"
    rows = passages._units(docs(*[(i, same) for i in range(50)]).coalesce(1).selectExpr(
        "doc_id", "text", "xxhash64(text) AS text_hash"), 3, 6).collect()
    per_unit = {}
    for r in rows:
        per_unit.setdefault(r.unit, []).append(r)
    for own in per_unit.values():
        assert len(own) == 50
        assert [len(r["keys"]) for r in own] == [3] + [0] * 49 and sum(r.shingles is not None for r in own) == 1


def test_verified_similarity_of_long_paragraphs(spark, docs):
    """Paragraphs of which a word differs link exactly if their shingles' Jaccard reaches 0.8."""
    rng = random.Random(12)
    plain = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    # words that are no borders, so that a line is one paragraph
    def line(n):
        return [w for w in plain(4 * n) if not passages._word(w) & 1][:n]

    near, far = line(100), line(30)
    other = [*near[:50], line(1)[0], *near[51:]]
    off = [*far[:15], line(1)[0], *far[16:]]
    found = passages.find_repeats(docs(*(" ".join(x) for x in (near, other, far, off))), max_list=2).collect()
    assert {r.doc_id for r in found} == {0, 1}
    assert len({tuple(r.clusters) for r in found}) == 1


def _planted(rng, edits, pairs=20, length=60):
    """Pairs of texts that share a passage without punctuation, in words that no other text has."""
    rows, spans = [], {}
    for i in range(pairs):
        passage = [f"p{rng.randrange(10**7)}" for _ in range(length)]
        for copy in range(2):
            held = list(passage)
            if copy:
                for k in range(edits):
                    held[(k + 1) * length // (edits + 1)] = f"e{rng.randrange(10**7)}"
            before, after = ([f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(3, 80))] for _ in range(2))
            rows.append((2 * i + copy, " ".join([*before, *held, *after])))
            at = len(" ".join([*before, ""]))
            spans[2 * i + copy] = (at, at + len(" ".join(held)))
    return rows, spans


@pytest.mark.parametrize("edits", [0, 1])
def test_true_extents_of_passages(spark, docs, edits):
    """Passages set into other words come out from their first to their last word, an edited word inside."""
    rows, spans = _planted(random.Random(21 + edits), edits)
    got = passages.find_repeats(docs(*rows)).collect()
    exact = {r.doc_id for r in got if (r.start, r.end) == spans[r.doc_id]}
    for r in got:
        assert spans[r.doc_id][0] <= r.start < r.end <= spans[r.doc_id][1] and r.kept == (r.doc_id % 2 == 0)
    # a passage, or what an edit leaves of one, may hold no whole paragraph of six words
    assert len(exact) >= 0.9 * len(rows)
    left = {r.doc_id: r.text for r in passages.remove_repeats(docs(*rows)).collect()}
    for i, text in rows:
        if i % 2 == 0:
            assert left[i] == text
        elif i in exact:
            assert left[i].split() == (text[:spans[i][0]] + text[spans[i][1]:]).split()


@pytest.mark.xfail(reason="57 own words, 2.1 %, go with similar paragraphs; the limit is 2 %", strict=False)
def test_every_long_repeat_against_brute_force(spark, docs):
    """Words of repeats of over 50 words go, found by comparing all 51-word windows; the first copies stay."""
    rng = random.Random(23)
    pool = [[f"p{rng.randrange(10**7)}" for _ in range(rng.randrange(51, 120))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(4, 40))]
            held = rng.choice(pool)
            a = rng.randrange(0, 20)
            words += held[a:] if rng.random() < 0.5 else held
        rows.append((i, " ".join(words)))
    long, small = 51, 25
    got = {r.doc_id: r.text.split() for r in passages.remove_repeats(docs(*rows), min_words=small).collect()}
    seen, must, gone, lost = set(), 0, 0, 0
    for i, text in rows:
        words = text.split()
        grams = [tuple(words[k:k + long]) for k in range(len(words) - long + 1)]
        covered = {j for k, g in enumerate(grams) if g in seen or g in grams[:k] for j in range(k, k + long)}
        seen.update(grams)
        left = set(got[i])
        must += len(covered)
        gone += sum(words[j] not in left or words.count(words[j]) > 1 for j in covered)
        lost += sum(w not in left for w in words if w[0] == "o")
    assert gone >= 0.97 * must > 2000
    # own words inside a paragraph that is similar to another one as a whole go with it
    assert lost <= 0.02 * sum(w[0] == "o" for _, text in rows for w in text.split())
    everywhere = {w for words in got.values() for w in words}
    assert {w for held in pool for w in held} & {w for _, text in rows for w in text.split()} <= everywhere


def test_growing_and_bridging_alone():
    grown = passages._grown([
        {"left": "x B c ", "kept_left": "y b  c ", "right": " d E f", "kept_right": " d e g"},
        {"left": "", "kept_left": None, "right": " 1 x 3 4 5 6 7 8 z", "kept_right": " 1 2 3 4 5 6 7 8 9 10"}])
    way = lambda *v: dict(zip(("here", "there", "same", "own", "kept"), v))
    none = [way(0, 0, 0, 0, 0)]
    assert grown == [{"left": [way(2, 2, 2, 4, 5)], "right": [way(2, 2, 2, 4, 4)]},
                     {"left": none, "right": [way(1, 1, 1, 2, 2), way(8, 8, 7, 16, 16)]}]
    for words, reached in ((20, 1), (60, 8)):
        run = {"words": words}
        assert passages._ends_of({"run": run, **grown[1]}, 0.8)[1]["here"] == reached
    text = " ".join(f"w{i}" for i in range(2000))
    middle = text.index(" w1000 ") + 1
    for low in (0, middle - 40):
        around = passages._before(text, middle, low, 10**6)
        assert around == text[low:middle]
        assert text[:middle].endswith(passages._before(text, middle, low, 6))
    assert passages._after(text, middle, len(text), 10**6) == text[middle:]
    assert text[middle:].startswith(passages._after(text, middle, len(text), 6))


def test_unrepeated_short_lines_stay(spark, docs):
    """A list of short lines between a repeated header and footer is text of its own."""
    rng = random.Random(13)
    header, footer = (" ".join(f"{p}{i}" for i in range(14)) + "." for p in "hf")
    lists = ["\n".join(f"item {rng.randrange(10**6)} is {rng.randrange(10**6)}" for _ in range(30)) for _ in range(2)]
    rows = [f"{header}\n{items}\n{footer}" for items in lists]
    both = [*rows, rows[1] + "\nand an end of its own in this text"]
    assert {r.doc_id: r.text for r in passages.remove_repeats(docs(*rows)).collect()} == dict(enumerate(rows))
    got = {r.doc_id: r.text for r in passages.remove_repeats(docs(*both)).collect()}
    assert got[0] == both[0] and got[1] == both[1] and got[2].split() == "and an end of its own in this text".split()


def test_bands_reach_the_recall():
    n = passages.tune_bands(0.8, 0.99)
    assert 1 - 0.2 ** n >= 0.99 > 1 - 0.2 ** (n - 1)
    assert 1 - (1 - 0.8 ** 3) ** passages.tune_bands(0.8, 0.99, rows=3) >= 0.99


def test_results_of_a_batch_are_not_held_together(spark, docs):
    """A function over texts gives its results away slice by slice, and texts without a passage stay where they are."""
    def held(texts: list) -> list:
        import pyarrow as pa

        return [f"{pa.total_allocated_bytes():012d}" + "x" * 20_000 for _ in texts]

    rows = spark.range(0, 2000, 1, 1).select(sliced_udf(held, "string", 100)(F.lit("t")).alias("t"))
    sizes = [int(r.t) for r in rows.select(F.substring("t", 1, 12).alias("t")).collect()]
    assert len(sizes) == 2000 and max(sizes) - sizes[0] < 6 * 100 * 20_000  # all results have 40 MB

    def lengths(texts: list, more: list) -> list:
        return [None if t is None else len(t) + n for t, n in zip(texts, more)]

    table = docs("a", None, "ccc", "", "eeeee")
    got = table.select("doc_id", sliced_udf(lengths, "bigint", 2)(F.col("text"), F.col("doc_id").cast("int")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 1, 1: None, 2: 5, 3: 3, 4: 9}
    assert table.where("false").select(sliced_udf(held, "string")(F.col("text")).alias("t")).collect() == []
    assert table.where(sliced_udf(held, "string")(F.col("text")) != "").count() == 5
