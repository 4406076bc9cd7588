"""Exact top-k inner products, by length of the vectors.

Vectors are scaled to integers. Candidates are sorted by length and cut into blocks; a query
needs only blocks whose longest vector could still reach its k-th best score (Cauchy-Schwarz).
Inside a block, vectors are seen through the rotation that diagonalises the candidates' second
moments (their right singular vectors), so that the first coordinates carry most of a product:
partial sums over a growing head plus the product of the tails' lengths bound the score from
above, and pairs whose bound stays below the k-th best are dropped. What is left is computed
exactly. Equal scores go to the smaller id.

Queries first meet the block of the longest vectors, which gives each a k-th best score to prune
with; then blocks of queries meet the other blocks, each pair of blocks in a task of its own, and
at most ``k`` candidates per query leave a task.

Vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no
part. Vectors of different length are compared as if the shorter one ended in zeros. A query with
fewer than ``k`` candidates gets all of them. Of repeated rows each is a candidate for the others;
rows with the query's own id are not. Of repeated rows of a query each is a query of its own with ``k``
ranks of its own, so that equal ones give equal answers, once each. Scores must fit 64 bits: lengths beyond that raise an error.
An empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syndica.llm.common import pick
from syndica.llm.vectors import usable
from syndica.session import materialize

TOP = 20
BLOCK = 4096  # candidates of a block
QUERIES = 1024  # queries that meet a block at a time
HEADS = (0.25, 0.5, 0.75)  # shares of the coordinates after which bounds are taken
CHUNK = 512


def _scaled(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v binary int64, norm2 bigint, dim)`` of the vectors that take part."""
    rows = pick(vectors, vec_id=vec_id, embedding=embedding).where("vec_id is not null")

    def run(batches):
        for frame in batches:
            ids, packed, norms, dims = [], [], [], []
            for i, v in zip(frame["vec_id"], frame["embedding"]):
                if v is None or not usable(list(v)):
                    continue
                whole = [int(x) for x in np.floor(scale * np.asarray(v, np.float64))]
                norm = sum(x * x for x in whole)
                if norm >= 1 << 63:
                    raise ValueError(f"scores of vector {i} do not fit 64 bits")
                ids.append(i)
                packed.append(np.array(whole, np.int64).tobytes())
                norms.append(norm)
                dims.append(len(whole))
            yield pd.DataFrame({"vec_id": ids, "v": packed, "norm2": norms, "dim": dims})

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"vec_id {id_type}, v binary, norm2 bigint, dim int")


def _matrix(packed, dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim), np.int64)
    for i, p in enumerate(packed):
        row = np.frombuffer(p, np.int64)
        out[i, : len(row)] = row
    return out


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all candidates, largest first, from their summed outer products."""
    def partial(batches):
        total = np.zeros((dim, dim))
        for frame in batches:
            x = _matrix(frame["v"], dim).astype(np.float64)
            total += x.T @ x
        if total.any():
            yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim),
                                "s": total.ravel()})

    cells = rows.select("v").mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(
        F.sum("s").alias("s")).collect()  # dim x dim numbers
    moments = np.zeros((dim, dim))
    for c in cells:
        moments[c.i, c.j] = c.s
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


class Pruner:
    """Best candidates of a block for a block of queries."""

    def __init__(self, rotation: np.ndarray, top: int):
        self.rotation, self.top, dim = rotation, top, len(rotation)
        self.heads = sorted({int(np.ceil(h * dim)) for h in HEADS} - {0, dim})

    def best(self, q_ids, copies, q: np.ndarray, least: np.ndarray, c_ids, c: np.ndarray) -> list[tuple]:
        """``(query, copy, candidate, score)``, at most ``top`` a query; candidates longest first.
        ``least`` holds scores that a candidate must reach."""
        exact = max(self._longest(q), self._longest(c)) < 1 << 52
        qt, ct = q @ self.rotation, c @ self.rotation
        tails = [(np.linalg.norm(qt[:, h:], axis=1), np.linalg.norm(ct[:, h:], axis=1)) for h in self.heads]
        lengths = np.linalg.norm(qt, axis=1), np.linalg.norm(ct, axis=1)
        slack = 1e-9 * (1 + lengths[0].max(initial=0) * lengths[1].max(initial=0))
        least = least.astype(np.float64).copy()
        held_s = np.full((len(q), 0), 0, np.int64)
        held_i = np.full((len(q), 0), 0, np.int64)
        held_k = np.zeros((len(q), 0), bool)
        for at in range(0, len(c), CHUNK):
            block = slice(at, at + CHUNK)
            live = np.nonzero(lengths[0] * lengths[1][block].max() + slack >= least)[0]
            if not len(live):
                break
            sums, done = np.zeros((len(live), len(ct[block]))), 0
            alive = np.ones(sums.shape, bool)
            for h, (q_tail, c_tail) in zip(self.heads, tails):
                sums += qt[live, done:h] @ ct[block, done:h].T
                done = h
                alive = sums + q_tail[live][:, None] * c_tail[block][None, :] + slack >= least[live][:, None]
                if alive.mean() < 0.2:
                    break
            rows, cols = np.nonzero(alive)
            cols += at
            keep = c_ids[cols] != q_ids[live[rows]]
            rows, cols = rows[keep], cols[keep]
            if exact and len(rows) > 0.05 * alive.size:
                scores = (q[live].astype(np.float64) @ c[block].astype(np.float64).T)[rows, cols - at].astype(np.int64)
            else:
                scores = np.concatenate([np.einsum("ij,ij->i", q[live[rows[i:i + 65536]]], c[cols[i:i + 65536]])
                                         for i in range(0, max(len(rows), 1), 65536)])
            good = scores >= least[live[rows]]
            rows, cols, scores = live[rows[good]], cols[good], scores[good]
            held_s, held_i, held_k, least = self._merge(held_s, held_i, held_k, least, rows, cols, scores, c_ids)
        i, j = np.nonzero(held_k)
        return list(zip(q_ids[i].tolist(), copies[i].tolist(), c_ids[held_i[i, j]].tolist(), held_s[i, j].tolist()))

    @staticmethod
    def _longest(x: np.ndarray) -> float:
        return float((x.astype(np.float64) ** 2).sum(1).max(initial=0))

    def _merge(self, held_s, held_i, held_k, least, rows, cols, scores, c_ids):
        """The best of what is held and what is new, and the scores they ask for from now on."""
        old_r, old_j = np.nonzero(held_k)
        r = np.concatenate((old_r, rows))
        i = np.concatenate((held_i[old_r, old_j], cols))
        s = np.concatenate((held_s[old_r, old_j], scores))
        order = np.lexsort((c_ids[i], -s, r))
        r, i, s = r[order], i[order], s[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, i, s, nth = (x[nth < self.top] for x in (r, i, s, nth))
        shape = (len(least), self.top)
        new_s, new_i, new_k = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        new_s[r, nth], new_i[r, nth], new_k[r, nth] = s, i, True
        full = new_k[:, -1]
        least = np.where(full, np.maximum(least, new_s[:, -1]), least)
        return new_s, new_i, new_k, least


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(number, norm2, ids, vs)``: candidates in blocks, longest first by range partition."""
    dealt = rows.repartitionByRange(F.col("norm2").desc(), F.col("vec_id").asc()).sortWithinPartitions(
        F.col("norm2").desc(), F.col("vec_id").asc()).withColumn("part", F.spark_partition_id())
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        held, number = None, 0
        for frame in batches:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held) >= size:
                yield block(held.iloc[:size], number)
                held, number = held.iloc[size:], number + 1
        if held is not None and len(held):
            yield block(held, number)

    def block(frame, number):
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "number": [number],
                             "norm2": [int(frame["norm2"].max())], "ids": [frame["vec_id"].to_numpy()],
                             "vs": [list(frame["v"])]})

    return dealt.mapInPandas(
        run, f"part int, number int, norm2 bigint, ids array<{id_type}>, vs array<binary>")


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = 64, block: int = BLOCK,
          vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows for which ``queries`` (an expression over
    ``vec_id``) holds, against all rows."""
    rows = materialize(_scaled(vectors, scale, vec_id, embedding), "scaled")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    dim = rows.agg(F.max("dim")).first()[0] or 0
    shared = rows.sparkSession.sparkContext.broadcast(Pruner(_rotation(rows, dim), k))  # dim x dim numbers
    blocks = materialize(_blocks(rows, block), "blocks")
    # blocks are numbered by length; their statistics are one row for every ``block`` vectors
    longest_first = Window.orderBy(F.col("norm2").desc(), "part", "number")
    numbers = materialize(blocks.select("part", "number", "norm2").withColumn(
        "block", F.row_number().over(longest_first) - 1), "block-numbers")
    blocks = blocks.join(numbers.select("part", "number", "block"), ["part", "number"])
    copies = Window.partitionBy("vec_id").orderBy("v")
    asked = materialize(rows.where(queries).select(
        F.col("vec_id").alias("query_id"), F.row_number().over(copies).alias("copy"), F.col("v").alias("q"),
        F.col("norm2").alias("q_norm2")), "queries")

    def against(pairs: DataFrame) -> DataFrame:
        """Best candidates of ``(block, query_id, copy, q, least)`` rows, each in the task of its block."""
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                pruner = shared.value
                at = right.iloc[0]
                c, c_ids = _matrix(at["vs"], dim), np.asarray(at["ids"])
                for i in range(0, len(left), QUERIES):
                    some = left.iloc[i:i + QUERIES]
                    found += pruner.best(some["query_id"].to_numpy(), some["copy"].to_numpy(), _matrix(some["q"], dim),
                                         some["least"].fillna(-np.inf).to_numpy(), c_ids, c)
            return pd.DataFrame(found, columns=["query_id", "copy", "vec_id", "score"])

        both = pairs.groupBy("block", "some").cogroup(
            blocks.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("block", "some"))
        return both.applyInPandas(run, f"query_id {id_type}, copy int, vec_id {id_type}, score bigint")

    n_queries = asked.count()
    parts = max(1, -(-n_queries // (16 * QUERIES)))  # queries that meet a block in one task are bounded
    some = F.pmod(F.xxhash64("query_id", "copy"), F.lit(parts)).cast("int").alias("some")
    none = F.lit(None).cast("double").alias("least")
    first = materialize(against(asked.select(F.lit(0).alias("block"), some, "query_id", "copy", "q", none)), "first-block")
    reached = first.groupBy(F.col("query_id").alias("_id"), F.col("copy").alias("_copy")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    seeded = asked.join(reached, (F.col("query_id") == F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    # how short the longest vector of a block may be; blocks beyond that cannot hold a better one
    seeded = seeded.withColumn("least", F.when(F.col("n") >= k, F.col("kth").cast("double")))
    others = numbers.where("block > 0").select("block", "norm2")
    ladder = others.agg(F.max("block").alias("last")).first()["last"]
    if ladder is None:
        rest = first.limit(0)
    else:
        wanted = seeded.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(ladder)))).join(others, "block").where(
            F.col("least").isNull()
            | (F.sqrt(F.col("q_norm2").cast("double")) * F.sqrt(F.col("norm2").cast("double")) * (1 + 1e-9) >= F.col("least")))
        rest = against(wanted.select("block", some, "query_id", "copy", "q", "least"))
    best = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
