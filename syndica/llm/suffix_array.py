"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are of type S if smaller than the one after them, else of type L; a leftmost S suffix is
one after an L. The substrings between leftmost ones are sorted, by inducing in long texts over few symbols
and symbol by symbol in others, and named; if names repeat, the text of names is sorted the same way, one level down. From the sorted leftmost suffixes
all L suffixes follow in one pass upwards and all S suffixes in one downwards.

A pass goes symbol by symbol over whole arrays where the text is much longer than its alphabet, as
bytes are, and suffix by suffix where names are many. Both are linear and give the same order.
"""

from __future__ import annotations

import numpy as np

_NONE = np.empty(0, np.int64)


def types_of(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; equal symbols go by what follows them."""
    step = np.diff(text.astype(np.int64))
    changes = np.where(step != 0, np.arange(len(step)), len(text))
    is_s = np.ones(len(text), bool)
    is_s[:-1] = step[np.minimum.accumulate(changes[::-1])[::-1]] > 0
    return is_s


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in order. Its last symbol is 0 and stands nowhere else."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    is_s = types_of(text)
    leftmost = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _by_symbol if len(text) > 256 * symbols else _by_suffix
    if induce is _by_symbol:
        is_leftmost = np.zeros(len(text), bool)
        is_leftmost[leftmost] = True
        order = induce(text, is_s, leftmost, symbols)
        order = order[is_leftmost[order]]
        names = _names(text, leftmost, order)
    else:
        order, names = _refined(text, is_s, leftmost, symbols)
    if names[-1] < len(names) - 1:
        reduced = np.empty(len(text), np.int64)
        reduced[order] = names
        order = leftmost[suffix_array(reduced[leftmost], int(names[-1]) + 1)]
    return induce(text, is_s, order, symbols)


def _names(text: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings between leftmost suffixes, in their sorted order; equal ones share theirs."""
    length = np.zeros(len(text), np.int64)
    length[leftmost] = np.append(np.diff(leftmost), 0) + 1
    a, b = order[:-1], order[1:]
    new = length[a] != length[b]
    open_, at = np.flatnonzero(~new), 0
    while len(open_):
        same = text[a[open_] + at] == text[b[open_] + at]
        new[open_[~same]] = True
        at += 1
        open_ = open_[same & (length[a[open_]] > at)]
    return np.concatenate(([0], np.cumsum(new)))


def _refined(text: np.ndarray, is_s: np.ndarray, leftmost: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost suffixes in the order of the substrings up to the next one, and their numbers.

    Groups of equal beginnings are divided by one more symbol and its type at a time. A substring that ends is
    equal to all others of its group, as its last symbol would be a leftmost suffix in them as well.
    """
    key = 2 * text.astype(np.int64) + is_s
    length = np.append(np.diff(leftmost), 0) + 1
    order = np.argsort(key[leftmost], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(key[leftmost[order]]) != 0
    at, open_ = 1, np.arange(len(order))
    while True:
        ends = np.append(new[1:], True)
        open_ = open_[~(new[open_] & ends[open_]) & (length[order[open_]] > at)]
        if not len(open_):
            return leftmost[order], np.cumsum(new) - 1
        group = np.maximum.accumulate(np.where(new[open_], open_, 0))
        own = order[open_]
        divided = group * (2 * symbols) + key[leftmost[own] + at]
        sorted_ = np.argsort(divided, kind="stable")
        order[open_] = own[sorted_]
        new[open_[1:]] |= np.diff(divided[sorted_]) != 0
        at += 1


def _by_symbol(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Both passes, a symbol at a time: what starts with it is complete when its turn comes, but for
    suffixes that it induces itself, which come in rounds."""
    at = text[seeds]
    parts = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[parts], np.arange(symbols + 1))
    small: list[np.ndarray] = []  # type L by symbol
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def send(places, wanted, symbol):
        """The suffixes before ``places`` of the wanted type to their symbols; returns those of ``symbol``."""
        before = places - 1
        before = before[(before >= 0) & (is_s[before] == wanted)]
        first = text[before]
        if not len(first):
            return before
        sorted_ = np.argsort(first, kind="stable")
        before, first = before[sorted_], first[sorted_]
        cuts = np.flatnonzero(np.diff(first)) + 1
        own = _NONE
        for piece, symbol_of in zip(np.split(before, cuts), first[np.concatenate(([0], cuts))].tolist()):
            if symbol_of == symbol:
                own = piece
            else:
                waiting[symbol_of].append(piece)
        return own

    def rounds(symbol, wanted):
        done, now = [], np.concatenate(waiting[symbol]) if waiting[symbol] else _NONE
        while len(now):
            done.append(now)
            now = send(now, wanted, symbol)
        waiting[symbol] = []
        return np.concatenate(done) if done else _NONE

    for symbol in range(symbols):
        small.append(rounds(symbol, False))
        send(seeds[parts[bounds[symbol]:bounds[symbol + 1]]], False, symbol)
    found: list[np.ndarray] = []
    waiting[0].append(np.array([len(text) - 1]))
    for symbol in range(symbols - 1, -1, -1):
        found += [rounds(symbol, True), small[symbol][::-1]]
        send(small[symbol][::-1], True, symbol)
    return np.concatenate(found)[::-1]


def _by_suffix(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Both passes, a suffix at a time, over one array with a stretch for each symbol."""
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    # by place: the symbol before it if that is of type L or S, else -1, as after the last place for ones not filled yet
    before = np.concatenate(([-1], text[:-1], [-1]))
    wanted = np.concatenate(([False], is_s[:-1], [False]))
    large = np.where(wanted, -1, before).tolist()
    small = np.where(wanted, before, -1).tolist()
    filled = np.full(len(text), -1, np.int64)
    at = text[seeds]
    parts = np.argsort(at, kind="stable")
    own = np.bincount(at, minlength=symbols)
    filled[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(own), own)] = seeds[parts]
    places = filled.tolist()
    heads = (ends - counts).tolist()
    for i in places:  # grows ahead of the loop
        c = large[i]
        if c >= 0:
            head = heads[c]
            places[head] = i - 1
            heads[c] = head + 1
    tails = ends.tolist()
    for i in reversed(places):  # likewise
        c = small[i]
        if c >= 0:
            tails[c] = tail = tails[c] - 1
            places[tail] = i - 1
    return np.array(places, np.int64)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place: how much a suffix shares with the one before it in order; 0 for the smallest.

    Where the symbols to the left of both agree, a place shares one less than the place before it;
    only the others are compared, symbol by symbol. ``text`` holds numbers below 65,536.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    places = np.arange(n)
    fresh = (before <= 0) | (places == 0)
    fresh[~fresh] = text[places[~fresh] - 1] != text[before[~fresh] - 1]
    compare = np.flatnonzero(fresh & (before >= 0))
    shared = np.zeros(n, np.int64)
    wide = np.concatenate((text.astype(np.uint64), np.zeros(4, np.uint64)))
    four = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    a, b, at = compare, before[compare], 0
    while len(a):
        differ = four[a + at] ^ four[b + at]
        other = differ != 0
        low = differ[other]
        more = np.zeros(len(low), np.int64)
        for bits in (16, 32, 48):
            more += low & np.uint64((1 << bits) - 1) == 0
        shared[a[other]] = at + more
        a, b, at = a[~other], b[~other], at + 4
    last = np.maximum.accumulate(np.where(fresh, places, 0))
    return shared[last] - (places - last)
