"""Bytes that repeat: every byte covered by a string of ``length`` bytes that starts elsewhere too.

Repeats are decided by suffix arrays (``suffix_array``): suffixes of a shard are sorted by induced
sorting, and a place whose longest common prefix with a neighbour reaches ``length`` starts a repeat.
Shards hold what can match. Every window of ``length`` bytes names one of its ``ANCHOR``-byte
strings by content alone, the one with the least hash and of equal ones the first; equal windows
name the same, and a text's windows fall into stretches with one anchor each. So the stretches of one
anchor, each with the bytes of its windows (a context), go to one shard, and no match is lost.

Most anchors occur once, and nothing of theirs is moved. Equal texts and equal contexts are told by
128-bit hashes and counted before anything is shuffled: all windows of a context that occurs twice
repeat, and a shard gets it once. An anchor with more than ``MAX_CONTEXTS`` different contexts, as a
very common line has, is not sorted in one task: its windows are compared by 128-bit hashes in an
aggregation, which is exact for the rest and has no hot key but for true repeats.

Places are bytes of the UTF-8 text, matches never cross texts, strings are judged on the input. NULL
and empty texts, and those shorter than ``length``, have no repeats. Repeated rows repeat each other.
Rows without an id are texts like any other. There are no ties to break; every occurrence counts.
Very long texts are read in pieces and marked whole. An empty table gives no rows; other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import pick, sliced
from syndica.llm.suffix_array import permuted_common_prefixes, suffix_array
from syndica.session import join_measured, materialize

LENGTH = 200
ANCHOR = 100
MAX_CONTEXTS = 2048
SHARD_BYTES = 1 << 20
STEP = 1 << 19  # windows of a long text that are looked at together
_SEEN = 500_000
_FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class Anchors:
    """Finds the anchors of texts; its tables serve buffers of up to four ``STEP``."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, self.size = length, anchor, 4 * STEP
        back = pow(_FACTOR, -1, 1 << 64)
        self.powers, self.inverses = (
            np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.size, f, np.uint64))), dtype=np.uint64)
            for f in (_FACTOR, back))
        mixed = np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX)
        self.codes = (mixed ^ mixed >> np.uint64(29)) * np.uint64(_FACTOR) | np.uint64(1)

    def _buffer(self, pieces: list[bytes]):
        """``(piece, first window, windows, anchor)`` of the stretches of a few short pieces."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, width = len(data), self.length - self.anchor + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:n], out=sums[1:])
        keys = (sums[self.anchor:] - sums[:-self.anchor]) * self.inverses[:n - self.anchor + 1]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(_MIX)
        keys ^= keys >> np.uint64(32)
        # the place in the low bits makes the first of equal ones the least
        low = np.uint64(self.size - 1)
        placed = keys & ~low | np.arange(len(keys), dtype=np.uint64)
        padded = np.full(-(-len(placed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:len(placed)] = placed
        padded = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = (np.minimum(behind[:n - self.length + 1], ahead[width - 1:n - self.anchor + 1]) & low).astype(np.int64)
        sizes = np.array([len(p) for p in pieces])
        begins = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - self.length + 1, 0)
        owner = np.repeat(np.arange(len(pieces)), windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        named = least[begins[owner] + at]
        first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
        return owner[first], at[first], np.diff(np.append(first, len(named))), keys[named[first]].view(np.int64)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(first windows, numbers of windows, anchors)`` of every text."""
        found: list[list] = [[] for _ in texts]
        pieces, of, held = [], [], 0

        def flush():
            nonlocal held
            if pieces:
                owner, at, many, anchors = self._buffer(pieces)
                cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
                for k, (i, begin) in enumerate(of):
                    own = slice(cuts[k], cuts[k + 1])
                    found[i].append((at[own] + begin, many[own], anchors[own]))
            pieces.clear()
            of.clear()
            held = 0

        for i, text in enumerate(texts):
            for begin in range(0, len(text) - self.length + 1, STEP):
                piece = text[begin:begin + STEP + self.length - 1]
                if held + len(piece) > 2 * STEP:
                    flush()
                pieces.append(piece)
                of.append((i, begin))
                held += len(piece)
        flush()
        none = (np.empty(0, np.int64),) * 3
        return [tuple(np.concatenate(c) for c in zip(*f)) if f else none for f in found]


_finders: dict[tuple[int, int], Anchors] = {}


def _finder(length: int, anchor: int) -> Anchors:
    if (length, anchor) not in _finders:
        _finders[length, anchor] = Anchors(length, anchor)
    return _finders[length, anchor]


def _keyed(docs: DataFrame) -> DataFrame:
    """With the 128-bit identity of each text."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("again"), "text")})


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(columns) if columns else np.empty(0, np.int64)
    offsets = np.cumsum([0, *map(len, columns)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()).cast(kind))


def _anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One narrow row per document: its size, the hash of its bytes, and the stretches of its windows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            texts = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
            found = _finder(length, anchor).of(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                 _lists([f[0] for f in found], pa.int32()), _lists([f[1] for f in found], pa.int32()),
                 _lists([f[2] for f in found], pa.int64())],
                names=["doc_id", "k1", "k2", "n_bytes", "whole_sha256", "first", "windows", "anchors"])

    return docs.mapInArrow(
        run, f"doc_id {id_type}, k1 bigint, k2 bigint, n_bytes bigint, whole_sha256 string, "
        "first array<int>, windows array<int>, anchors array<bigint>").withColumn("row", F.monotonically_increasing_id())


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    """Contexts of candidate stretches: identity and place of all, the bytes of those new to a task."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in sliced(batches, 64):
            rows = []
            for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted"))):
                data = text.encode("utf-8")
                for w in wanted:
                    context = data[w["first"]:w["first"] + w["windows"] + length - 1]
                    digest = xxhash.xxh3_128_digest(context)
                    rows.append((k1, k2, w["first"], w["windows"], w["anchor"], digest,
                                 None if digest in seen else context))
                    seen.add(digest)
            if len(seen) > _SEEN:
                seen.clear()
            if rows:
                k1, k2, first, windows, anchors, digests, contexts = zip(*rows)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int32()),
                     pa.array(windows, pa.int32()), pa.array(anchors, pa.int64()), pa.array(both[:, 0].copy()),
                     pa.array(both[:, 1].copy()), pa.array(contexts, pa.binary())],
                    names=["k1", "k2", "first", "windows", "anchor", "c1", "c2", "context"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, first int, windows int, anchor bigint, c1 bigint, c2 bigint, "
                                 "context binary")


def repeated_places(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For every context the places at which a string of ``length`` bytes starts that also starts
    elsewhere in them, by the suffix array of them all."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.zeros(int(sizes.sum()) + len(contexts) + 1, np.uint16)  # 1 ends a context, 0 the whole
    begins = np.cumsum(sizes + 1) - sizes - 1
    text[:-1] = 1
    inside = np.ones(len(text), bool)
    inside[-1] = False
    inside[begins + sizes] = False
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 2
    order = suffix_array(text, 258)
    shared = permuted_common_prefixes(text, order)
    long = shared[order] >= length  # with the one before it
    repeated = np.zeros(len(text), bool)
    repeated[order[long]] = True
    repeated[order[:-1][long[1:]]] = True
    places = np.flatnonzero(repeated)
    cuts = np.searchsorted(places, np.append(begins, len(text)))
    own = [places[a:b] - begin for a, b, begin in zip(cuts[:-1], cuts[1:], begins)]
    return [p[p <= size - length] for p, size in zip(own, sizes.tolist())]  # no string reaches over an end


_MARKS = "anchor bigint, c1 bigint, c2 bigint, places array<int>"


def _marks(rows: list[tuple], places: list[np.ndarray]) -> pa.RecordBatch:
    some = [i for i, p in enumerate(places) if len(p)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([rows[i][k] for i in some], pa.int64()) for k in range(3)),
         _lists([places[i] for i in some], pa.int32())], names=["anchor", "c1", "c2", "places"])


def _shards(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated places of contexts; those of one anchor are sorted together."""
    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "context"))):
                if last == row[:3]:
                    continue  # new to several tasks
                if last and held >= SHARD_BYTES and row[0] != last[0]:
                    yield _marks(rows, repeated_places([r[3] for r in rows], length))
                    rows, held = [], 0
                rows.append(row)
                held, last = held + len(row[3]), row[:3]
        if rows:
            yield _marks(rows, repeated_places([r[3] for r in rows], length))

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "c1", "c2")
    return dealt.mapInArrow(run, _MARKS)


def _by_window(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, window by window."""
    def run(batches):
        for batch in sliced(batches, 256):
            out, digests = [], []
            for a, c1, c2, context in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "context"))):
                for i in range(len(context) - length + 1):
                    out.append((a, c1, c2, i))
                    digests.append(xxhash.xxh3_128_digest(context[i:i + length]))
            if out:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))),
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    names=["anchor", "c1", "c2", "place", "w1", "w2"])

    distinct = contexts.dropDuplicates(["anchor", "c1", "c2"])
    windows = materialize(distinct.mapInArrow(
        run, "anchor bigint, c1 bigint, c2 bigint, place int, w1 bigint, w2 bigint"), "windows")
    several = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return windows.join(several, ["w1", "w2"]).groupBy("anchor", "c1", "c2").agg(
        F.sort_array(F.collect_list("place")).alias("places"))


def _repeats_of_texts(docs: DataFrame, rows: DataFrame, length: int, max_contexts: int) -> tuple[DataFrame, DataFrame]:
    """``(k1, k2, text)`` of texts that share an anchor with another, and ``(k1, k2, first, places)``
    of their repeated windows."""
    long = rows.where(F.col("n_bytes") >= length)
    copies = long.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).where("n > 1")
    single = join_measured(long, copies.select("k1", "k2", "least"), ["k1", "k2"], "left").where(
        "least is null or least = row")
    stretches = single.select("k1", "k2", F.explode(F.arrays_zip("first", "windows", F.col("anchors").alias("anchor")))
                              .alias("w")).select("k1", "k2", "w.*")
    common = stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    wanted = materialize(
        join_measured(stretches, common, "anchor").groupBy("k1", "k2").agg(
            F.collect_list(F.struct("first", "windows", "anchor")).alias("wanted")), "wanted-stretches")
    own = wanted.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    have = join_measured(docs, own, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_semi")
    texts = materialize(have.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]), "texts")

    found = materialize(_occurrences(texts, length), "contexts")
    counted = materialize(found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n")), "context-counts")
    # anchors with something to decide: several contexts, not all of which occur twice
    open_ = materialize(counted.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select(
        F.col("anchor").alias("_anchor"), (F.col("contexts") > max_contexts).alias("hot")), "open-anchors")
    fresh = found.where("context is not null").select("anchor", "c1", "c2", "context")
    same = F.col("anchor") == F.col("_anchor")
    marks = _shards(join_measured(fresh, open_.where("not hot"), same, "left_semi"), length)
    if open_.where("hot").take(1):
        marks = marks.unionByName(_by_window(join_measured(fresh, open_.where("hot"), same, "left_semi"), length))
    key = ["anchor", "c1", "c2"]
    twice = counted.where("n > 1").select(*key, F.lit(None).cast("array<int>").alias("places"))
    verdicts = marks.unionByName(twice)
    whole = F.sequence(F.lit(0), F.col("windows") - 1)
    places = found.drop("context").join(verdicts, key).select(
        "k1", "k2", "first", F.coalesce("places", whole).alias("places"))
    return texts.select("k1", "k2", "text"), places


def _merged(places: list[dict], length: int) -> list[tuple[int, int]]:
    """Stretches of bytes that windows at these places cover."""
    at = np.unique(np.concatenate([np.asarray(p["places"], np.int64) + p["first"] for p in places]))
    cuts = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate(([0], cuts + 1))].tolist(), (at[np.append(cuts, -1)] + length).tolist()))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def find_repeats(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, max_contexts: int = MAX_CONTEXTS,
                 with_kept: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start, end>>, kept_sha256)`` of every row.

    ``spans`` are the maximal stretches of bytes to remove, in order; ``kept_sha256`` is the hash of
    the bytes that remain, which come along as ``kept`` if asked for (they may end inside a character).
    """
    anchor = anchor or length // 2
    docs = _keyed(pick(docs, doc_id=doc_id, text=text))
    rows = materialize(_anchored(docs, length, anchor), "anchored")
    texts, places = _repeats_of_texts(docs, rows, length, max_contexts)
    by_text = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "places")).alias("places"))
    key = ["k1", "k2"]
    out = "k1 bigint, k2 bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"

    def cut(batches):
        for batch in sliced(batches, 64):
            made = []
            for k1, k2, body, own in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "places"))):
                spans = _merged(own, length)
                kept = _without(body.encode("utf-8"), spans)
                made.append((k1, k2, [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(),
                             kept if with_kept else None))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), span, pa.string(), pa.binary()))],
                names=["k1", "k2", "spans", "kept_sha256", "kept"])

    found = materialize(texts.join(by_text, key).mapInArrow(cut, out), "spans-by-text")
    # a text that stands there twice goes whole, whatever it shares with others
    long = rows.where(F.col("n_bytes") >= length)
    copies = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    narrow = rows.select("doc_id", *key, "n_bytes", "whole_sha256")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    gone = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    copied = join_measured(narrow, copies, key, "left_semi").select(
        "doc_id", "n_bytes", gone.alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    rest = join_measured(join_measured(narrow, copies, key, "left_anti"), found, key, "left")
    if with_kept:  # texts that share nothing are kept as they are
        own = join_measured(docs.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "text"), rest.where(
            "kept is null").select(*key), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_semi")
        whole = own.dropDuplicates(["_k1", "_k2"])
        rest = rest.join(whole, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").withColumn(
            "kept", F.coalesce("kept", F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    rest = rest.select("doc_id", "n_bytes", F.coalesce("spans", empty).alias("spans"),
                       F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
    result = copied.unionByName(rest)
    return result if with_kept else result.drop("kept")


def repeat_digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of the result of ``find_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        "kept_sha256")
