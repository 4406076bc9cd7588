"""Encoders and counters against the libraries, packing against its contract."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from syndica.llm import bpe, packing, pieces, token_count

PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "'s", "'", "1", "22", "!!", "$", "中", " ", "\x1c", "\x85",
         "<|endoftext|>", "<|end", "the", "\U0001f600", "ab" * 30, "Hello world", " "]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def multi():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_library_and_decodes(multi):
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    for text in [*_texts(3000, 1), "a" * 5000, "ab" * 3000, "thequick" * 500, "", "é" * 999]:
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == multi.encode_ordinary(text), repr(text[:80])
        assert codec.decode(ids) == text.encode()


def test_rank_queue_leaves_in_order_of_rank_and_place():
    rng = random.Random(4)
    queue, top, want = bpe.RankQueue(5000), 0, []
    for _ in range(400):
        rank, place = rng.randrange(5000) // rng.choice([1, 40]), rng.randrange(1000)
        top |= queue.push(rank, place)
        want.append((rank, place))
    got = []
    while top:
        group = (top & -top).bit_length() - 1
        word = (group << bpe.SHIFT) + (queue.mid[group] & -queue.mid[group]).bit_length() - 1
        rank = (word << bpe.SHIFT) + (queue.low[word] & -queue.low[word]).bit_length() - 1
        got += [(rank, p) for p in sorted(queue.buckets[rank])]
        queue.low[word] &= queue.low[word] - 1
        if not queue.low[word]:
            queue.mid[group] &= queue.mid[group] - 1
            if not queue.mid[group]:
                top &= top - 1
    assert got == sorted(want)


def test_counts_equal_library_whatever_the_chunks(library):
    counter = token_count.counter(public_tokenizers.path(token_count.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for text in [*_texts(3000, 2), "a" * 5000, "ab" * 3000, "thequick" * 500]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want, repr(text[:80])
        assert counter.count(text, rng.randint(1, 12)) == want, repr(text[:80])


def test_state_maps_compose_associatively():
    counter = token_count.counter(public_tokenizers.path(token_count.VOCABULARY), public_tokenizers.PATTERN)
    for text in _texts(300, 6):
        parts = [counter.state_map(text[i:i + 5]) for i in range(0, len(text), 5)] or [counter.state_map("")]
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = counter.compose(left, p)
        for p in parts[-2::-1]:
            right = counter.compose(p, right)
        assert counter.finish(left) == counter.finish(right) == counter.count(text)


def test_packed_ids_equal_library(library):
    ids = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    for text in _texts(3000, 3):
        assert list(memoryview(ids.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_pieces_join_to_the_text():
    for text in _texts(500, 7):
        assert "".join(pieces.split_pieces(text)) == text
        parts = pieces.spaced_pieces(text)
        assert parts is None or " ".join(parts) == text


def test_token_tables(spark, clashing, library, multi):
    texts = [None, "", "hello world", "hello world", "x " * 1500, (None, "no id"), "<|endoftext|> end"]
    df = clashing(*texts)
    plain = [(t[1] if isinstance(t, tuple) else t) or "" for t in texts]
    got = token_count.count_tokens(df, chunk=100).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (len(t), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for t in plain)
    got = bpe.round_trip(df).collect()
    assert sorted((r.n_tokens, r.decoded_sha256) for r in got) == sorted(
        (len(multi.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for t in plain)
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(plain)
    empty = df.limit(0)
    for made in (token_count.count_tokens(empty), bpe.round_trip(empty), packing.pack_documents(empty)):
        assert made.collect() == []


def _packed_as_it_should_be(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, clashing, library):
    rng = random.Random(8)
    texts = ["word " * rng.randrange(0, 60) for _ in range(300)] + [None, "", "same same"] + ["same same"] * 40
    texts += ["long text " * 300, (None, "no id")]
    rows = packing.pack_documents(clashing(*texts), capacity=64, with_ids=True).collect()
    n = _packed_as_it_should_be(rows, 64)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 64) + 2
    want = {}
    for i, t in enumerate(texts):
        if not isinstance(t, tuple):
            want[i] = library.encode(t or "", add_special_tokens=False).ids + [2]
    got = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        if r.doc_id is not None:
            got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, own in got.items():
        own.sort(key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == struct.pack(f"<{len(want[i])}I", *want[i])
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert all(r.length == 64 for r in own[1:])
    packed = packing.sequences(spark.createDataFrame(rows))
    assert sum(len(r.ids) for r in packed.collect()) == 4 * total


def _one_by_one(lengths, capacity):
    """Best-two-fit piece by piece: one sequence at a time, without counting lengths."""
    left, out = sorted(lengths), []
    while left:
        filled, gap = [], capacity
        while (fits := [x for x in left if x <= gap]):
            filled.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        while gap:
            smallest, room = min(filled), gap + min(filled)
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[:i] if a + b <= room]
            if not pairs or max(pairs)[0] <= smallest:
                break
            both, one = max(pairs)
            filled.remove(smallest)
            for x in (one, both - one):
                left.remove(x)
                filled.append(x)
            left = sorted([*left, smallest])
            gap = room - both
        out.append(sorted(filled))
    return out


def test_fillings_equal_packing_one_by_one():
    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.randint(1, rng.choice([10, 40])) for _ in range(rng.randint(0, 120))]
        counts = [lengths.count(n) for n in range(41)]
        fillings = packing.best_two_fit(counts, 40)
        assert sum(t * c * n for t, f in fillings for n, c in f) == sum(lengths)
        got = sorted(sorted(n for n, c in f for _ in range(c)) for t, f in fillings for _ in range(t))
        want = _one_by_one(lengths, 40)
        assert sum(map(len, got)) == sum(map(len, want)) and len(got) == len(want)
        assert all(sum(f) <= 40 for f in got)


def test_cut():
    assert packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_ids_of_odd_texts_are_those_of_the_library():
    own = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    for text in ("", " " * 300_000 + "a", "\n" * 60_000, "x" * 40_000, "it's we'LL 12 34½ \x1c\x1d a  \n\n b",
                 "a <|endoftext|> b", "é" * 5_000, "\u3000" * 70_000 + "1"):
        ids = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
