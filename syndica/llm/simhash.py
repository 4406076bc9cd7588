"""Near duplicates by SimHash fingerprints and an inverted index on their bytes.

A fingerprint has eight positional bytes, and two that differ in at most two bits share at least
six. The index lists fingerprints by what such a pair must share: its bytes fall into four
blocks of two, at most two blocks are touched, so the two others agree and the pair meets in the
list of that pair of blocks. (Lists of single bytes would hold a 256th of the table each.) For
every two fingerprints of a list the shared positional bytes are tallied; pairs that reach the
six are kept and verified bit by bit.

A list longer than ``max_list`` is not expanded into pairs. It is split by two more positional
bytes of the four it leaves open, of which a pair shares two; then the lists agree in six bytes,
any length reaching the count. What is still longer is linked by bits: members within two bits
of each other have, as their sets of members' one-bit variants, a value in common, and members
that share one differ in two bits at most, so linking each to the smallest of the value loses
nothing and adds nothing.

Texts without words have fingerprint zero and link like any other; NULL counts as such a text.
Rows with a NULL id get a fingerprint and no component. Repeated rows and copies share a
fingerprint and are compared once. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import connected_components, map_batches, pick
from syndica.session import materialize

SEED = 42
SHINGLE = 3
DISTANCE = 2  # bits; the blocks and the linking by bits below are made for it
MAX_LIST = 128
_BYTES_AT_ONCE = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased word shingles of a whole text."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BYTES_AT_ONCE):
        block = slice(at, at + _BYTES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[block].tolist(), ends[block].tolist())], np.uint64)
        octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[8 * i: 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(doc_id, fp bigint, text_hash bigint)`` of every row, without a shuffle."""
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))

    def run(batch):
        found = [fingerprint(t or "", shingle) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "fp": [f - (1 << 64) if f >> 63 else f for f in found],
                "text_hash": batch["text_hash"]}

    return map_batches(
        docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint, text_hash bigint")


def _octet(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _lists(fps: DataFrame, choices: list[tuple[int, ...]], fp: str = "fp") -> Column:
    """Keys of the index lists: which positions, and the bytes there."""
    keys = []
    for number, positions in enumerate(choices):
        mask = sum(255 << 8 * p for p in positions)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("lists"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bytes")))
    return F.array(*keys)


def _sized(entries: DataFrame, max_list: int) -> tuple[DataFrame, DataFrame]:
    """Entries of lists of at most ``max_list`` members, and those of longer ones."""
    long = entries.groupBy("lists", "bytes").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > max_list).select(F.col("lists").alias("_l"), F.col("bytes").alias("_b"))
    long = materialize(long, "long-lists")
    same = (F.col("lists") == F.col("_l")) & (F.col("bytes") == F.col("_b"))
    return entries.join(long, same, "left_anti"), entries.join(long, same, "left_semi")


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs of a list that share enough positional bytes, verified."""
    right = entries.select("lists", "bytes", F.col("fp").alias("other"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    shared = sum((F.when(_octet(differ, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    return (
        entries.join(right, ["lists", "bytes"]).where(F.col("fp") < F.col("other"))
        .where(shared >= 8 - DISTANCE).where(F.bit_count(differ) <= DISTANCE)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )


def near_links(fps: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, which connect all those that differ in at
    most two bits; links of long lists stand for the pairs they imply."""
    blocks = [(0, 1), (2, 3), (4, 5), (6, 7)]
    first = [a + b for a, b in combinations(blocks, 2)]
    entries = fps.select("fp", F.explode(_lists(fps, first)).alias("key")).select("fp", "key.*")
    short, long = _sized(entries, max_list)

    second = [rest for positions in first for rest in combinations(sorted(set(range(8)) - set(positions)), 2)]
    six = [tuple(sorted(first[n // 6] + rest)) for n, rest in enumerate(second)]
    every = _lists(long, six)
    split = long.select("fp", F.explode(F.slice(every, F.col("lists") * 6 + 1, F.lit(6))).alias("key"))
    # the same six bytes are reached from several lists
    canonical = F.create_map(*[F.lit(v) for n, s in enumerate(six) for v in (n, six.index(s))])
    split = split.select("fp", canonical[F.col("key.lists")].alias("lists"), "key.bytes").distinct()
    split = materialize(split, "long-lists-split")
    split_short, dense = _sized(split, max_list)

    bits = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    variants = dense.select("fp").distinct().select(
        "fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("a"))
    by_bit = variants.join(least, "variant").where("fp <> a").select("a", F.col("fp").alias("b"))
    return _pairs(short).unionByName(_pairs(split_short)).unionByName(by_bit).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE,
                    doc_id: str = "doc_id", text: str = "text",
                    max_list: int = MAX_LIST) -> DataFrame:
    """``(doc_id, fingerprint, component_id, text_hash)``: fingerprints as 16 hex digits, components
    named by their smallest id; with the id, the hash (Spark's xxhash64) names a row's text."""
    rows = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    distinct = materialize(
        rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first")),
        "distinct-fingerprints")
    parts = connected_components(near_links(distinct.select("fp"), max_list))
    member = distinct.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first")
    named = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = member.join(named, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "text_hash")


def superfluous(found: DataFrame) -> DataFrame:
    """``(doc_id, text_hash)`` of the rows of ``near_duplicates`` to drop so that one of each component stays.

    The row with the smallest id stays, of several texts with that id the one of least hash. Equal
    rows (same id, same text) stay or go together.
    """
    first = found.where("doc_id = component_id").groupBy("component_id").agg(
        F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most").select(
        F.col("component_id").alias("_id"), "least")
    others = found.where("doc_id = component_id").join(first, F.col("doc_id") == F.col("_id")).where(
        "text_hash <> least").select("doc_id", "text_hash")
    return found.where("doc_id <> component_id").select("doc_id", "text_hash").unionByName(others).distinct()
