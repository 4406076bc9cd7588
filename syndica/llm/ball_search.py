"""Ranked lexical search as exact maximum inner products over ball trees of sparse vectors.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, both of
whole numbers, so that a score is an exact integer. Every task cuts its documents into blocks,
builds a ball tree over each and goes through it best-first: a ball with centre c and radius r holds
no document that scores above q.c + |q| r, rounded up by more than doubles can be wrong; the walk
ends when the best open ball cannot reach the k-th score known. Scores are integers and only
computed at leaves.

Vectors have only the terms that some query asks for, which changes no score. Terms are counted
over all documents. First a slice of the documents is searched, then the whole with each query's
k-th score of the slice as its bar from the start; so what tasks return hardly grows with their
number. Queries are taken in blocks of bounded size, each against all documents.

A NULL or empty text has no terms and is never found; a NULL query finds nothing. Documents
without an id count in the statistics and are not returned. Repeated documents are documents of
their own, ties go by smaller id and then by chance between equal rows; each row of the queries is
searched by itself, also where ids repeat. Empty tables give no rows, other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syndica.llm.common import pick, sliced
from syndica.session import materialize

K = 50
LEAF = 24
TREE_DOCS = 1024  # documents of a tree, fewer if they have many different terms
TREE_CELLS = 4_000_000
QUERY_TERMS = 500_000  # terms of a block of queries, in expectation
PILOT = 16  # the slice is one in so many documents
TASK_DOCS = 65_536
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits and of everything beyond ASCII, only A to Z lower-cased."""
    return _TERM.findall((text or "").translate(_LOWER))


class Tree:
    """Ball tree over the rows of a matrix of whole numbers, kept in doubles, which are exact for them.

    Nodes are numbered from the root; rows are moved so that every node holds a stretch of them.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        centres, radii, self.stretch, self.children = [], [], [], []
        todo = [(0, len(rows), None)]
        while todo:
            a, b, parent = todo.pop()
            own = rows[self.order[a:b]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            number = len(centres)
            centres.append(centre)
            radii.append(away.max())
            self.stretch.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(number)
            if b - a > leaf and radii[-1] > 0:
                far = own[np.argmax(away)]
                other = own[np.argmax(((own - far) ** 2).sum(1))]
                along = np.argsort(own @ (other - far), kind="stable")
                self.order[a:b] = self.order[a:b][along]
                half = (a + b) // 2
                todo += [(half, b, number), (a, half, number)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.columns = np.ascontiguousarray(rows[self.order].T)

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, no less than any score in it."""
        length = math.sqrt(float(weights @ weights))
        return (self.centres[:, columns] @ weights + length * self.radii) * (1 + 1e-9) + 1

    def best(self, columns: np.ndarray, weights: np.ndarray, least):
        """Leaves' ``(rows, scores)``, best bound first, while a bound reaches ``least()``."""
        bounds = self.bounds(columns, weights).tolist()
        open_, whole = [(-bounds[0], 0)], weights.astype(np.int64)
        while open_ and -open_[0][0] >= least():
            node = heappop(open_)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heappush(open_, (-min(bounds[child], bounds[node]), child))
            else:
                a, b = self.stretch[node]
                yield self.order[a:b], whole @ self.columns[columns, a:b].astype(np.int64)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents by asked-for term."""
    total = rows.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(n_terms, np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # <= n_terms rows
        df[r["t"]] = r["count"]
    return total.docs, total.terms or 0, df


def _vectors(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document: its number of terms, and those asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # of QUERY_TERMS at most

    def run(batches):
        known = shared.value
        for batch in sliced(batches):
            n, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                n.append(len(found))
                counts = sorted((known[t], tf) for t, tf in Counter(found).items() if t in known)
                terms.append([t for t, _ in counts])
                tfs.append([tf for _, tf in counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n bigint, terms array<int>, tfs array<int>")


def _trees(batches, docs: int, terms: int):
    """``(ids, rows, the terms that their columns stand for)`` of blocks of documents."""
    ids, cells = [], []
    for batch in batches:
        for doc_id, n, own, tf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
            ids.append(doc_id)
            # 64-bit whole numbers throughout: the share of a document in the average length, then the impact
            tf, m = np.array(tf, np.int64), 100 - 50 + 50 * n * docs // terms
            cells.append((np.array(own, np.int64), 1_000_000_000 * tf // (1000 * tf + 20 * m)))
            if len(ids) >= TREE_DOCS or len(ids) % 32 == 0 and len(ids) * len(
                    np.unique(np.concatenate([c for c, _ in cells]))) >= TREE_CELLS:
                yield ids, *_matrix(cells)
                ids, cells = [], []
    if ids:
        yield ids, *_matrix(cells)


def _matrix(cells) -> tuple[np.ndarray, np.ndarray]:
    columns, at = np.unique(np.concatenate([c for c, _ in cells]), return_inverse=True)
    rows = np.zeros((len(cells), len(columns)))
    rows[np.repeat(np.arange(len(cells)), [len(c) for c, _ in cells]), at] = np.concatenate([i for _, i in cells])
    return rows, columns


def _search(rows: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], docs: int, terms: int, k: int,
            least: dict[int, int]) -> DataFrame:
    """``(query, doc_id, score)``: of every task the ``k`` best of each query that reach ``least``."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches):
        asked, bar = shared.value
        found = [[] for _ in asked]  # heaps of (score, id), the worst first
        for ids, matrix, columns in _trees(batches, docs, terms):
            tree = Tree(matrix)
            for number, (own, weights) in enumerate(asked):
                at = np.searchsorted(columns, own)
                at[at == len(columns)] = 0
                has = columns[at] == own if len(columns) else np.zeros(len(own), bool)
                if not has.any():
                    continue
                heap, floor = found[number], max(1, bar.get(number, 1))

                def reach():
                    return max(floor, heap[0][0]) if len(heap) == k else floor

                for where, scores in tree.best(at[has], weights[has], reach):
                    good = np.nonzero(scores >= reach())[0]
                    for i in good.tolist():
                        entry = (int(scores[i]), _Last(ids[where[i]]))
                        if len(heap) < k:
                            heappush(heap, entry)
                        elif entry > heap[0]:
                            heapreplace(heap, entry)
        kept = [(number, last.id, score) for number, heap in enumerate(found) for score, last in heap]
        if kept:
            number, ids, scores = zip(*kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(ids, id_arrow), pa.array(scores, pa.int64())],
                names=["query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(run, f"query int, doc_id {id_type}, score bigint")


class _Last:
    """An id that is greater the smaller it is."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other):
        return other.id < self.id

    def __eq__(self, other):
        return self.id == other.id


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tasks(rows: DataFrame, docs: int) -> DataFrame:
    """The same rows in at most as many tasks as keep all cores busy and hold ``TASK_DOCS`` each."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, docs // TASK_DOCS))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, scores above 0."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text)
    items = materialize(pick(items, item_id=item_id, text=item_text).withColumn(
        "item", F.monotonically_increasing_id()), "items")
    # a term has two characters at least with what parts it from the next
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (2 * QUERY_TERMS)
    results = []
    for block in range(blocks):
        asked = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        ranked = _rank_block(docs, [(r["item"], sorted(set(terms_of(r["text"])))) for r in asked], k)
        if ranked is not None:
            results.append(ranked)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if not results:
        empty = spark.createDataFrame([], f"item bigint, rank int, doc_id {id_type}, score bigint")
        results.append(empty)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _rank_block(docs: DataFrame, asked: list[tuple[int, list[str]]], k: int) -> DataFrame | None:
    """``(item, rank, doc_id, score)`` for the queries of one block; None if they have no term."""
    spark = docs.sparkSession
    asked = [(item, terms) for item, terms in asked if terms]
    if not asked:
        return None
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    rows = materialize(_vectors(docs, numbers), "term-vectors")
    n, length, df = statistics(rows, len(numbers))
    if not n:
        return None
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
    queries = []
    for _, terms in asked:
        own = np.array([numbers[t] for t in terms], np.int64)
        queries.append((own, np.array([weight[i] for i in own], np.float64)))
    useful = rows.where("doc_id is not null and size(terms) > 0")
    part = _tasks(useful, n // PILOT).where(F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0)
    pilot = _ranked(_search(part, queries, n, length, k, {}), k)
    least = {r["query"]: r["score"] for r in pilot.where(F.col("rank") == k).select("query", "score").collect()}
    found = materialize(_ranked(_search(_tasks(useful, n), queries, n, length, k, least), k), "ranked")
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query int, item bigint")
    return found.join(named, "query").select("item", F.col("rank").cast("int"), "doc_id", "score")
