"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syndica.llm import (
    ball_search, bpe, caps, language, packing, passages, quality, secret_scan, simhash, suffix_dedup, token_count, topk,
    word_runs,
)
from syndica.llm.common import crc_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op2_top_inner_products(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def held_out(of: int, rest: int):
    """Whether a document is left out of learning; a NULL id is not, as it has no label."""
    return F.coalesce(crc_of(F.col("doc_id")) % of == rest, F.lit(False))


@query
def op3_quality(spark, sf_dir):
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_secrets(spark, sf_dir):
    return secret_scan.span_digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op5_cap_filters(spark, sf_dir):
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_token_counts(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_best_two_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs, ~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op9_repeated_passages(spark, sf_dir):
    """One row per repeat; documents without one have none."""
    found = passages.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "words", "kept", "clusters", "first_doc")


@query
def op10_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_digests(suffix_dedup.find_repeats(table(spark, sf_dir, "documents")))


@query
def op12_ball_search(spark, sf_dir):
    return ball_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = """regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
sql("op12_ball_search", f"""
WITH words AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM words WHERE len(ts) > 0),
tf AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf
       FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM words) GROUP BY doc_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, whole GROUP BY t),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
scored AS (SELECT item_id, doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN tf USING (t) JOIN weights USING (t), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")


def op13_words(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which one in ten ends in a repeated stretch (by its id's CRC-32);
    a document without an id keeps its words."""
    mark = zlib.crc32(str(doc_id).encode())
    n, rest = len(words), mark // 10
    if doc_id is None or mark % 10 or not n:
        return words
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    copies = -(-(n - start) // period)
    return words[:start] + (words[start:start + period] * copies)[:n - start]


@query
def op13_word_runs(spark, sf_dir):
    return word_runs.run_digests(word_runs.find_runs(table(spark, sf_dir, "documents"), prepare=op13_words))
