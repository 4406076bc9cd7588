"""Best-two-fit packing of documents into sequences of bounded length.

A sequence is filled greedily with the longest piece that still fits; then its smallest piece is
replaced by the two unpacked pieces that fit the gap it leaves most tightly, as long as that
fills more. Only lengths matter to that, so it runs on the histogram of lengths (at most
``capacity`` numbers, whatever the input): the same filling is repeated until one of its lengths
runs short, which is what packing piece by piece would do, and gives some thousand fillings at
most. Pieces get a rank among those of their length, and a filling says which ranks it takes.

Ranks are counted in two steps, inside each task and then over tasks, so neither a length that a
third of the documents share nor a large input meets in one task.

NULL counts as an empty text; a text always has at least its end token. Longer documents are cut
into full pieces from the end, so that only the first may be shorter. Documents with NULL or
repeated ids are packed like any others, an empty table gives no rows, and other columns of the
input are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syndica.llm.common import pick, sliced
from syndica.llm.token_count import load_vocabulary
from syndica.session import materialize

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
_LONG_SPACE = re.compile(r"\s{50000}")


class Ids:
    """Packed token ids of texts as the tokenizers library gives them.

    A byte-level vocabulary's merges, in their order, are ranks too, and tiktoken applies those to a
    whole text several times faster; the tests compare both. Texts that hold a special string or white
    space in a row that its patterns cannot take, and files of another kind, go through tokenizers itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        self.path, self._tokenizer = path, None
        self.special: tuple[str, ...] = ()
        self.ranked = None
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        split = data.get("pre_tokenizer") or {}
        if data["model"]["type"] == "BPE" and not data.get("normalizer") and byte_level.items() <= split.items():
            import tiktoken

            vocabulary = load_vocabulary.__wrapped__(path)  # not kept
            self.special = vocabulary.special
            texts = {i: t for t, i in vocabulary.tokens.items()}
            merged = [token for _, token in sorted(vocabulary.merges.values())]
            order = [i for t, i in vocabulary.tokens.items() if len(t) == 1] + merged
            self.ids = np.array(order, "<u4")
            self.ranked = tiktoken.Encoding(
                "merges", pat_str=public_tokenizers.PATTERN, special_tokens={},
                mergeable_ranks={texts[i]: rank for rank, i in enumerate(order)})

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranked is None or any(s in text for s in self.special) or _LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ids[self.ranked.encode_ordinary(text)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Ids:
    return Ids(path)


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document: full ones, but for the first."""
    head = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n_tokens, capacity))]


def best_two_fit(counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(how often, [(length, copies), ...])`` for pieces of which ``counts[length]`` exist."""
    left = np.array(counts, np.int64)
    fillings = []
    while (longest := int(np.max(np.nonzero(left)[0], initial=0))) > 0:
        used = np.zeros(capacity + 1, np.int64)
        gap, at = capacity, longest
        while gap and at:
            copies = min(gap // at, int(left[at]))
            used[at] += copies
            gap -= copies * at
            below = np.nonzero(left[: min(gap, at - 1) + 1])[0]
            at = int(below[-1]) if len(below) else 0
        while gap and (better := _two_for_smallest(left - used, used, gap)):
            smallest, one, two = better
            used[smallest] -= 1
            used[one] += 1
            used[two] += 1
            gap += smallest - one - two
        lengths = np.nonzero(used)[0]
        times = int(np.min(left[lengths] // used[lengths]))
        left -= times * used
        fillings.append((times, [(int(n), int(used[n])) for n in lengths[::-1]]))
    return fillings


def _two_for_smallest(free: np.ndarray, used: np.ndarray, gap: int) -> tuple[int, int, int] | None:
    smallest = int(np.nonzero(used)[0][0])
    room = smallest + gap
    sizes = np.nonzero(free[: room + 1])[0]
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
    # a piece of the same length needs a second copy, else the next smaller one
    at = np.where((at >= 0) & (sizes[at] == sizes) & (free[sizes] < 2), at - 1, at)
    both = np.where(at >= 0, sizes + sizes[at], 0)
    best = int(np.argmax(both))
    if both[best] <= smallest:
        return None
    return smallest, int(sizes[best]), int(sizes[at[best]])


def _pieces(docs: DataFrame, capacity: int, end_id: int, path: str, with_ids: bool) -> DataFrame:
    """Pieces with their rank among those of the same length in the same task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, local bigint"
    if with_ids:
        schema += ", ids binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    end = struct.pack("<I", end_id)

    def run(batches):
        arrow, known, seen = to_arrow_schema(out), encoder(path), {}
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                ids = known.encode(text or "") + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + length)]
                    rank = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, i, start, length, zlib.crc32(part), rank, part)[: len(arrow)])
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, out).withColumn("part", F.spark_partition_id())


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                   path: str | None = None, with_ids: bool = False,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece,
    and its packed ``ids`` if asked for."""
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = materialize(
        _pieces(pick(docs, doc_id=doc_id, text=text), capacity, end_id, path, with_ids), "pieces")

    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = materialize(
        by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    counts = [0] * (capacity + 1)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # <= capacity rows
        counts[row.length] = row.n

    # where the ranks of a length change to another filling; a key holds the length and the rank
    slots, taken, sequence = [], [0] * (capacity + 1), 0
    for times, filling in best_two_fit(counts, capacity):
        offset = 0
        for length, copies in filling:
            slots.append((length << 48 | taken[length], sequence, copies, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    slots.sort()
    keys, firsts, copies_of, offsets = (np.array(c, np.int64) for c in (zip(*slots) if slots else [()] * 4))

    columns = [f for f in ("doc_id", "piece", "start", "length", "ids_crc32", "ids") if f in pieces.columns]
    ranked = pieces.join(by_task.select(
        F.col("length").alias("_length"), F.col("part").alias("_part"), "base"),
        (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")),
    ).select(*columns, (F.col("base") + F.col("local")).alias("rank"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, n << 48 | r, side="right") - 1
        nth = r - (keys[at] & ((1 << 48) - 1))
        return pd.DataFrame({"sequence_id": firsts[at] + nth // copies_of[at],
                             "offset": offsets[at] + nth % copies_of[at] * n})

    return ranked.withColumn("_at", place("length", "rank")).select(
        *columns, "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed ids of each sequence, of pieces made ``with_ids``.

    A group holds one sequence, so at most its capacity in tokens.
    """
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all")).select(
        "sequence_id", F.expr("aggregate(all.ids, X'', (a, b) -> concat(a, b))").alias("ids"))
