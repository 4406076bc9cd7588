"""Byte-level BPE encoding and decoding by a rank queue.

A pre-token is a linked list of byte positions. Every adjacent pair that is a token waits in the
bucket of its rank; a three-level bitmap over the ranks finds the lowest bucket that is not empty
by find-first-set, so a merge costs three word operations instead of a search through the list,
however long the pre-token. Entries whose pair has changed since are skipped when they come up.
Within a bucket positions leave in order, so that equal ranks merge from the left.

Nulls count as empty texts, which have no tokens. Any text is encoded whole; special strings are
ordinary text. Repeated rows give repeated results, an empty table an empty one, and other
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heappop, heappush

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from syndica.llm.common import map_batches, pick
from syndica.llm.pieces import Memo, spaced_pieces, split_pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHIFT, MASK = 6, 63  # words of 64 bits
BIT = [1 << i for i in range(4096)]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}


class RankQueue:
    """Positions by rank under a bitmap of three levels, of which the caller holds the outermost.

    A level has a bit for every word of the level below that is not zero, and the lowest a bit
    for every bucket with positions; ``x & -x`` isolates the first bit set.
    """

    __slots__ = ("low", "mid", "buckets")

    def __init__(self, n_ranks: int):
        n = (n_ranks >> SHIFT) + 1
        self.low, self.mid = [0] * n, [0] * ((n >> SHIFT) + 1)
        self.buckets: list[list[int] | None] = [None] * n_ranks

    def push(self, rank: int, position: int) -> int:
        """Adds a position and gives the bit that the outermost level needs."""
        bucket = self.buckets[rank]
        word = rank >> SHIFT
        group = word >> SHIFT
        if bucket:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.low[word] |= BIT[rank & MASK]
            self.mid[group] |= BIT[word & MASK]
        return BIT[group]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, memo: int = 300_000):
        self.ranks = load_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.queue = RankQueue(max(self.ranks.values(), default=0) + 1)  # empty between calls
        self.split = regex.compile(pattern).findall
        self.words = Memo(self._packed_word, memo)
        self.parts = Memo(self._packed_piece, memo)

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        get, queue = ranks.get, self.queue
        low, mid, buckets = queue.low, queue.mid, queue.buckets
        push, top = queue.push, 0  # the outermost level lives in a local, as pops are unrolled here
        after = list(range(1, n + 2))  # start of the next part; n at the end
        before = list(range(-1, n))
        # the rank for which a position waits, None if none
        wanted = [get(word[i:i + 2]) for i in range(n - 1)]
        wanted += (None, None)
        for i, rank in enumerate(wanted):
            if rank is not None:
                if buckets[rank]:
                    buckets[rank].append(i)  # rising, so still a heap
                else:
                    top |= push(rank, i)
        while top:
            group = (top & -top).bit_length() - 1
            bits = mid[group]
            w = (group << SHIFT) + (bits & -bits).bit_length() - 1
            bits = low[w]
            rank = (w << SHIFT) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                buckets[rank] = None
                low[w] = bits = bits & (bits - 1)
                if not bits:
                    mid[group] = bits = mid[group] & (mid[group] - 1)
                    if not bits:
                        top &= top - 1
            if wanted[i] != rank:
                continue  # stale
            j = after[i]
            wanted[j] = None
            end = after[i] = after[j]
            if end < n:
                before[end] = i
                new = wanted[i] = get(word[i:after[end]])
                if new is not None:
                    top |= push(new, i)
            else:
                wanted[i] = None
            if i:
                h = before[i]
                new = get(word[h:end])
                if new != wanted[h]:
                    wanted[h] = new
                    if new is not None:
                        top |= push(new, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i:after[i]]])
            i = after[i]
        return ids

    def _packed_word(self, word: str) -> bytes:
        ids = self.encode_word(word.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _packed_piece(self, piece: str) -> bytes:
        return b"".join([self.words[w] for w in self.split(piece)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts, known = spaced_pieces(text), self.parts
        if parts is None:
            return b"".join([known[p] for p in split_pieces(text)])
        parts[1:] = [" " + p for p in parts[1:]]
        return b"".join([known[p] for p in parts])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(packed).cast("I")])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids binary)``: the packed token ids of every text."""
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batch):
        known = codec(path, pattern)
        return {"doc_id": batch["doc_id"], "ids": [known.encode(t or "") for t in batch["text"]]}

    docs = pick(docs, doc_id=doc_id, text=text)
    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(ids: DataFrame, path: str | None = None, doc_id: str = "doc_id",
                     packed: str = "ids") -> DataFrame:
    """``(doc_id, bytes binary)``: what packed token ids stand for; NULL stays NULL."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch):
        known = codec(path, public_tokenizers.PATTERN)
        return {"doc_id": batch["doc_id"],
                "bytes": [None if p is None else known.decode(p) for p in batch["ids"]]}

    ids = pick(ids, doc_id=doc_id, ids=packed)
    return map_batches(ids, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoding and decoding in one pass,
    with digests instead of the ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batch):
        known = codec(path, pattern)
        counts, ids, decoded = [], [], []
        for t in batch["text"]:
            packed = known.encode(t or "")
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(known.decode(packed)).hexdigest())
        return {"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": ids,
                "decoded_sha256": decoded}

    docs = pick(docs, doc_id=doc_id, text=text)
    return map_batches(
        docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, "
        "ids_sha256 string, decoded_sha256 string")
