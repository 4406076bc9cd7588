"""Periodic runs of words, by enumerating maximal pairs bottom-up over the LCP-interval tree.

A run with period q and length n is the same as a pair of positions q apart whose suffixes share
exactly their first n - q words and whose left words differ: a maximal pair. So the suffixes of
a text are sorted, the tree of LCP intervals is walked from its leaves, and every node keeps its
positions in sorted lists by left word. Where two nodes join at depth d, pairs of positions with
different left words and at most d / (exponent - 1) apart are runs of at least ``exponent``
periods; nothing is extended or checked afterwards. Two positions that near occur in a word that
is itself periodic, so a position has few such partners with another left word, however often
the words come again. Multiples of a period give the same stretch, of which the shortest is kept.

Words are what stands between ASCII white space, compared byte by byte. NULL and empty texts have
no words and no runs. Ties between runs are all reported, in order of start and period. Rows are
searched one by one, whole, however long; repeated rows give repeated results, an empty table an
empty one, and other columns of the input are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import map_batches, pick

EXPONENT = 4
LENGTH = 6
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sorted_suffixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of non-negative numbers by doubling, and the LCP of each suffix with the one before."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    levels, span = [rank], 1
    while n and int(levels[-1].max()) < n - 1 and span < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        span *= 2
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return order, lcp
    left, right, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = np.maximum(a, b) + (1 << level) <= n  # ranks at the end stand for shorter words
        same = np.zeros(n - 1, bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        common[same] += 1 << level
    lcp[1:] = common
    return order, lcp


class _Node:
    """Positions of an LCP interval: all of them, and by left word."""

    __slots__ = ("every", "classes")

    def __init__(self, position: int, left: int):
        self.every, self.classes = [position], {left: [position]}

    def join(self, other: _Node, reach: int, left: list[int], found) -> _Node:
        """Both nodes' positions in one; calls ``found(i, j)`` for pairs between them that are at
        most ``reach`` apart and differ in their left word."""
        big, small = (self, other) if len(self.every) >= len(other.every) else (other, self)
        for word, own in small.classes.items():
            for x in own:
                lo, hi = bisect_left(big.every, x - reach), bisect_right(big.every, x + reach)
                if hi - lo <= len(big.classes):
                    near = [y for y in big.every[lo:hi] if left[y] != word]
                else:
                    near = []
                    for third, ys in big.classes.items():
                        if third != word:
                            near += ys[bisect_left(ys, x - reach):bisect_right(ys, x + reach)]
                for y in near:
                    found(min(x, y), max(x, y))
        for word, own in small.classes.items():
            into = big.classes.get(word)
            if into is None:
                big.classes[word] = own
            else:
                for x in own:
                    insort(into, x)
            for x in own:
                insort(big.every, x)
        return big


def runs_of_words(values: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of at least ``exponent`` periods and ``length``
    words, in order, in a text of numbered words."""
    order, lcp = sorted_suffixes(values)
    left = [-1, *values[:-1].tolist()]
    # a pair at depth d has d >= (exponent - 1) * q and d + q >= length
    least = max(exponent - 1, -(-length * (exponent - 1) // exponent))
    runs: dict[tuple[int, int], int] = {}

    def join(node, other, depth):
        def found(i, j):
            whole = depth + j - i
            if whole >= length and runs.get((i, whole), whole) > j - i:
                runs[i, whole] = j - i

        return node.join(other, depth // (exponent - 1), left, found)

    deep = np.nonzero(lcp >= least)[0]
    for group in np.split(deep, np.nonzero(np.diff(deep) > 1)[0] + 1) if len(deep) else ():
        stack: list[tuple[int, _Node]] = []  # open intervals, the deepest last
        current = _Node(int(order[group[0] - 1]), left[order[group[0] - 1]])
        for at, depth in zip(group.tolist(), lcp[group].tolist()):
            while stack and stack[-1][0] >= depth:
                above, node = stack.pop()
                current = join(node, current, above)
            stack.append((depth, current))
            current = _Node(int(order[at]), left[order[at]])
        while stack:
            above, node = stack.pop()
            current = join(node, current, above)
    return sorted((start, whole, period) for (start, whole), period in runs.items())


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, whole, period in runs:
        change[start + period] += 1
        change[start + whole] -= 1
    return [w for w, inside in zip(words, np.cumsum(change).tolist()) if not inside]


def _repeating(values: np.ndarray, owner: np.ndarray, exponent: int, length: int) -> set[int]:
    """The texts in which some sequence of as many words as the shallowest pair shares comes again."""
    span = max(exponent - 1, -(-length * (exponent - 1) // exponent))
    n = len(values) - span + 1
    if n <= 0:
        return set()
    mixed = (values.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    key = owner[:n].astype(np.uint64)
    for k in range(span):
        key = key * _FACTOR + mixed[k:n + k]
    inside = owner[:n] == owner[span - 1:]
    key, of = key[inside], owner[:n][inside]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return set(of[order][1:][same].tolist())


def find_runs(docs: DataFrame, exponent: int = EXPONENT, length: int = LENGTH,
              prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)`` of every row.

    ``collapsed`` is the text's words, joined by single spaces, without what runs repeat.
    ``prepare`` may change the words of a document first; it gets its id and its words.
    """
    docs = pick(docs, doc_id=doc_id, text=text)

    def run(batch):
        texts = [(t or "").encode("utf-8").split() for t in batch["text"]]
        if prepare is not None:
            texts = [prepare(d, words) for d, words in zip(batch["doc_id"], texts)]
        numbers: dict[bytes, int] = {}
        values = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64)
        ends = np.cumsum([len(words) for words in texts])
        owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
        runs: list[list] = [[] for _ in texts]
        for i in _repeating(values, owner, exponent, length):
            runs[i] = runs_of_words(values[ends[i] - len(texts[i]):ends[i]], exponent, length)
        return {"doc_id": batch["doc_id"], "n_words": [len(words) for words in texts],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs],
                "collapsed": [b" ".join(without_repeats(words, own)).decode("utf-8")
                              for words, own in zip(texts, runs)]}

    return map_batches(
        docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``
    of the result of ``find_runs``; the single run is the longest, then first, then of least period."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("_r"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    size = -F.col("_r.less")
    return rows.select(
        "doc_id", "n_runs", F.col("_r.start").alias("start"), size.alias("length"), F.col("_r.period").alias("period"),
        F.expr("(1000 * -_r.less) div _r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
