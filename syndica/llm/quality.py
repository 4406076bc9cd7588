"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

Every text becomes a few statistics of its characters, words and lines. Random Fourier features
of the standardised statistics approximate a Gaussian kernel, so a ridge regression on them is a
kernel regression; its normal equations are sums over rows, taken partition by partition and added
up. A quarter of the learning rows is kept out of the fit and gives the isotonic step function
that turns raw scores into probabilities. What reaches the driver is of fixed size: the normal
equations of the features and the counts of ``BINS`` score bins.

Scores depend on the text alone. NULL counts as an empty text and is scored like one. Rows with a
NULL id are scored and never learned from; labels that are NULL are ignored and several for one
document count with their mean. Without any usable label every score is 0.5. Repeated rows give
repeated results, an empty table an empty one, and other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import map_batches, pick, sliced_udf
from syndica.session import materialize

FEATURES = 384
RIDGE = 1e-4
SEED = 17
BINS = 4096
LOW, HIGH = -0.5, 1.5  # raw scores that the bins cover
STATISTICS = 26
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r",
            b".", b",", b"!?", b"|", b"#$%&*@^~+=<>\\_`", b"\"'()-:;[]{}/", bytes(range(128, 256))]
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c), _i] = 1


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    data = text.encode("utf-8")
    size = max(len(data), 1)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = histogram @ _TABLE / size
    used = histogram[histogram > 0] / size
    entropy = float(-(used * np.log2(used)).sum())
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    counts = Counter(words)
    most = max(counts.values(), default=0)
    again = sum(map(eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    long = int(lengths.max(initial=0))
    full = [x for x in lines if x]
    return [
        np.log1p(len(data)), np.log1p(len(words)), *np.sqrt(shares).tolist(), entropy,
        float(lengths.mean()) if len(words) else 0.0, float(lengths.std()) if len(words) else 0.0,
        np.log1p(long), len(counts) / n, np.log1p(len(counts)), most / n, again / n,
        len(set(full)) / max(len(full), 1), np.log1p(len(full)), np.log1p(n / max(len(full), 1)),
        sum(x[-1] in ".!?" for x in full) / max(len(full), 1),
    ]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, x array<float>)`` of every row, without a shuffle."""
    docs = pick(docs, doc_id=doc_id, text=text)

    def run(batch):
        return {"doc_id": batch["doc_id"], "x": [statistics(t or "") for t in batch["text"]]}

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((d, features)) / np.sqrt(d)  # bandwidth: root of d
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(raw, 0, 1) if self.steps is None else self.steps[bins(raw)]


def bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising step function closest to the means of the bins, by pooling adjacent violators; empty
    bins lie on the line between their neighbours."""
    known = np.nonzero(weight)[0]
    pools: list[list[float]] = []  # weight, total, bins
    for i in known:
        pools.append([weight[i], total[i], 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, t, n = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + t, pools[-1][2] + n]
    values = np.concatenate([np.full(int(n), t / w) for w, t, n in pools])
    return np.interp(np.arange(len(weight)), known, values)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sum over ``(x, y)`` rows of the outer products of (features, y); one part per partition,
    added in two steps so that no group grows with the number of partitions squared."""
    def partial(batches):
        size = len(model.weights) + 1
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch.column("x"))),
                                 batch.column("y").to_numpy(zero_copy_only=False)])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["row", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # the same sum whatever arrives first
        total = np.sum([np.frombuffer(s) for s in group["sums"]], axis=0)
        return pd.DataFrame({"row": group["row"].iloc[:1], "part": group["part"].iloc[:1] % 64,
                             "sums": [total.tobytes()]})

    schema = "row int, part int, sums binary"
    parts = rows.mapInArrow(partial, "row int, sums binary").withColumn("part", F.spark_partition_id())
    first = parts.withColumn("some", F.col("part") % 64).groupBy("row", "some").applyInPandas(add, schema)
    found = first.groupBy("row").applyInPandas(add, schema).select("row", "sums").collect()
    return np.array([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.row)])


def fit(statistics_: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
        doc_id: str = "doc_id", features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """The model of the labelled rows for which ``learn`` (an expression over ``doc_id``) holds."""
    marks = pick(labels, _id=doc_id, y=label).where("_id is not null and y is not null").groupBy("_id").agg(
        F.avg("y").alias("y"))
    rows = materialize(
        statistics_.where(learn).join(marks, F.col("doc_id") == F.col("_id")).select(
            "x", "y", (F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0)
            .alias("calibrate")), "labelled")
    moments = rows.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(STATISTICS)]).first()
    if moments[0] is None:
        return None
    mean, scale = np.array(moments[:STATISTICS]), np.array(moments[STATISTICS:])
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), features, seed)

    kept_out = rows.where("calibrate")
    sums = _normal_equations(rows.where("not calibrate"), model)
    if not len(sums):  # too few labels to keep some out
        sums, kept_out = _normal_equations(rows, model), rows.limit(0)
    penalty = ridge * sums[-2, -2] * np.eye(len(sums) - 1)  # sums[-2, -2] is the number of rows
    penalty[-1, -1] = 0
    model.weights = np.linalg.lstsq(sums[:-1, :-1] + penalty, sums[:-1, -1], rcond=None)[0]

    def binned(batches):
        for batch in batches:
            at = bins(model.raw(_matrix(batch.column("x"))))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("y")], names=["bin", "y"])

    counted = kept_out.mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")).collect()  # <= BINS rows
    if counted:
        weight, total = np.zeros(BINS), np.zeros(BINS)
        for r in counted:
            weight[r.bin], total[r.bin] = r.n, r.total
        model.steps = isotonic(weight, total)
    return model


def score_of(text: Column, model: Model | None) -> Column:
    """The score of a text column, for filters that should not move the texts."""
    def score(texts: list) -> list:
        if model is None:
            return [0.5] * len(texts)
        rows = np.array([statistics(t or "") for t in texts], np.float32)
        return model.score(rows.astype(np.float64)).tolist()

    return sliced_udf(score, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
             doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``; labels are learned where ``learn`` holds."""
    rows = materialize(document_statistics(docs, doc_id, text), "statistics")
    model = fit(rows, labels, learn, label, doc_id, **options)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            score = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
