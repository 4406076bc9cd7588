"""From raw documents to packed training sequences, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor kept, and is
written before the next one reads it. Rows with a NULL id go through all stages: they are scored,
never count as copies, keep their passages, lose their secrets and are packed. NULL and empty texts
get the classifier's score for them, are near duplicates of each other, and are packed as an end token
each. Very long texts are read whole by every stage. Repeated rows are one from the second stage on;
of ties the smallest id stays. Empty tables give empty results. Other columns go through all stages
but the last; those that differ from one of documents, or from one before them, in case only are
left out, as Parquet could not hold both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syndica.llm import packing, passages, quality, secret_scan, simhash
from syndica.llm.common import crc_of, numbered, pick
from syndica.session import join_measured, materialize

MARK = "[SECRET]"


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents that the table has, and all others whose names are not theirs."""
    names = {c.lower(): c for c in reversed(docs.columns)} | {c: c for c in COLUMNS if c in docs.columns}
    chosen = [c for i, c in enumerate(docs.columns) if names[c.lower()] == c and docs.columns.index(c) == i]
    return pick(docs, **{c: c for c in chosen})


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length where the table tells it."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else changed


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    docs, labels = _documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = materialize(quality.document_statistics(docs), "statistics")
    learn = F.coalesce(crc_of(F.col("doc_id")) % 3 != 1, F.lit(False))
    model = quality.fit(rows, labels, learn)
    return docs.where(quality.score_of(F.col("text"), model) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates by SimHash: that with the smallest id, and of several
    texts with that id the one of least hash. Of rows with the same id and text one stays."""
    docs = _documents(docs)
    found = materialize(simhash.near_duplicates(docs).where("doc_id is not null"), "near-duplicates")
    gone = simhash.superfluous(found).toDF("_id", "_hash")
    again = materialize(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "doc_id", "text_hash").toDF("_id", "_hash"), "repeated-rows")
    own_id, own_hash = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    same = (F.col(own_id) == F.col("_id")) & (F.xxhash64(own_hash) == F.col("_hash"))
    kept = join_measured(numbered(docs), gone, same, "left_anti")
    if again.take(1):
        once = join_measured(kept, again, same, "left_semi").dropDuplicates([own_id, own_hash])
        kept = join_measured(kept, again, same, "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has."""
    return _with_text(passages.remove_repeats(_documents(docs)), F.col("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return _with_text(_documents(docs), secret_scan.redacted(F.col("text"), MARK))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # a fitted classifier and hashing stages have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
    return docs
