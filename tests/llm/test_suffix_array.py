from __future__ import annotations

import random

import numpy as np
import pytest

from syndica.llm import suffix_array as sa


def texts():
    rng = random.Random(1)
    yield [0]
    yield [3, 0]
    yield [2] * 50 + [0]
    yield [1, 2] * 40 + [0]
    yield list(range(30, 0, -1)) + [0]
    yield list(range(1, 30)) + [0]
    for _ in range(150):
        size = rng.randint(1, 5)
        part = [rng.randint(1, size) for _ in range(rng.randint(1, 60))]
        yield part * rng.randint(1, 4) + [rng.randint(1, size)] * rng.randint(0, 9) + [0]


@pytest.mark.parametrize("induce", ["_by_symbol", "_by_suffix", None])
def test_order_and_common_prefixes(induce, monkeypatch):
    if induce:
        for name in ("_by_symbol", "_by_suffix"):
            monkeypatch.setattr(sa, name, getattr(sa, induce))
    for text in texts():
        order = sa.suffix_array(np.array(text, np.int64), max(text) + 1)
        tails = [text[i:] for i in order.tolist()]
        assert tails == sorted(tails)
        shared = sa.permuted_common_prefixes(np.array(text, np.int64), order)
        assert shared[order[0]] == 0
        for x, y, i in zip(tails[:-1], tails[1:], order[1:].tolist()):
            assert shared[i] == next(k for k in range(len(x) + 1) if k == len(x) or x[k] != y[k])


def test_bytes_of_a_long_text():
    rng = np.random.default_rng(3)
    words = [rng.integers(3, 30, rng.integers(2, 9)) for _ in range(50)]
    text = np.concatenate([words[i] for i in rng.integers(0, 50, 6_000)] + [[0]]).astype(np.uint16)
    order = sa.suffix_array(text, 258)
    raw = text.astype(">u2").tobytes()
    tails = [raw[2 * i: 2 * i + 400] for i in order.tolist()]
    assert tails == sorted(tails) and sorted(order.tolist()) == list(range(len(text)))


def test_substrings_refined_symbol_by_symbol():
    """Order and names of the substrings between leftmost suffixes, types counting after symbols."""
    rng = random.Random(8)
    for _ in range(200):
        text = np.array([rng.randint(1, 3) for _ in range(rng.randint(2, 80))] * rng.choice((1, 3)) + [0])
        is_s = sa.types_of(text)
        leftmost = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
        order, names = sa._refined(text, is_s, leftmost, 4)
        to = dict(zip(leftmost.tolist(), [*leftmost[1:].tolist(), len(text) - 1]))
        keys = [[(text[k], is_s[k]) for k in range(i, to[i] + 1)] for i in order.tolist()]
        assert sorted(order.tolist()) == leftmost.tolist() and keys == sorted(keys)
        assert [b - a for a, b in zip(names, names[1:])] == [a != b for a, b in zip(keys, keys[1:])]
