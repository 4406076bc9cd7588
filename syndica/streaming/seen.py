"""Keys that earlier batches brought, kept so that a batch reads only what it may share with them.

Layout below one folder:

* ``delta/batch_id=<n>/bucket=<b>``: the keys that batch ``n`` brought;
* ``base/gen=<g>/bucket=<b>``: keys of folded batches, each with the batch that brought it;
* ``bloom/gen=<g>/bucket=<b>``: Bloom filters over the keys of a base bucket, as words of 64 bits;
* ``manifest``: for every compaction the generation of each bucket and the last batch folded.

A bucket holds a bounded number of keys on average: compaction doubles the number of buckets when
there are more, and otherwise rewrites only the buckets that recent batches touched. So a batch
of new keys reads the filters of its own buckets, and of the base only buckets in which a filter
says that a key may be; neither grows with the history, once there are more buckets than keys in a batch.
Buckets of fewer than ``KEYS_PER_FOLDER`` keys share folders, beyond ``FOLDERS`` of them: folder ``b`` has all
buckets that leave the remainder ``b``, each with a filter of its own. It is read and rewritten as a whole, and
the number of files grows with ``KEYS_PER_FOLDER`` keys however small the buckets are.

A batch compares itself with batches of smaller number only, in the base as in the deltas, and
replaces its own delta. So a batch that is run again, also after a compaction took it in, gives the
same rows. There is one writer, as a streaming query is one; readers never see half a compaction,
because the manifest names a generation only when it is complete.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syndica.session import materialize, path_exists, remove_partitions

KEYS = ("feed_key", "guid")
BUCKETS = 16  # to begin with
KEYS_PER_BUCKET = 65_536
FOLDERS = 64  # so many buckets have a folder each
KEYS_PER_FOLDER = 65_536
PROBES = 4
BITS_PER_KEY = 16

_MANIFEST = "gen bigint, buckets int, folders int, filter_words int, through bigint, bucket int, of_gen bigint, n_keys bigint"


class Manifest(NamedTuple):
    gen: int
    buckets: int
    folders: int  # divides the number of buckets
    filter_words: int  # words of a filter
    through: int  # the last batch folded into the base
    held: dict[int, tuple[int, int]]  # folder -> (generation, keys)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _key_columns(keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} string" for k in keys)


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The latest one; None before the first compaction. It has a row for each folder."""
    stored = _read(spark, f"{path}/manifest", _MANIFEST)
    last = stored.agg(F.max("gen")).first()[0]
    if last is None:
        return None
    rows = stored.where(F.col("gen") == last).collect()
    held = {r.bucket: (r.of_gen, r.n_keys) for r in rows if r.bucket is not None}
    # without a number of folders, every bucket has one
    return Manifest(last, rows[0].buckets, rows[0].folders or rows[0].buckets, rows[0].filter_words, rows[0].through, held)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether any batch has left its keys here."""
    return path_exists(spark, path)


def _hashed(df: DataFrame, keys: tuple[str, ...], folders: int) -> DataFrame:
    h = F.xxhash64(*keys)
    return df.withColumns({"_h": h, "bucket": F.pmod(h, F.lit(folders)).cast("int")})


def _probes(words: int) -> Column:
    """The places of a key's bits in the filter of its bucket: which word, and the bit in it."""
    places = [F.pmod(F.xxhash64(F.lit(i), "_h"), F.lit(64 * words)) for i in range(PROBES)]
    return F.explode(F.array(*[
        F.struct((p / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (p % 64).cast("int").alias("bit"))
        for p in places]))


def _with_probes(df: DataFrame, buckets: int, words: int) -> DataFrame:
    part = F.pmod("_h", F.lit(buckets)).cast("int").alias("part")
    probed = df.select("_h", "bucket", part, _probes(words).alias("_p"))
    return probed.select("_h", "bucket", "part", F.col("_p.word").alias("word"),
                         F.expr("shiftleft(_p.one, _p.bit)").alias("mask"))


def _of_buckets(spark: SparkSession, path: str, schema: str, manifest: Manifest, buckets) -> DataFrame:
    """The current generation of some folders; no other one is listed or read."""
    schema = f"{schema}, gen bigint, bucket int"
    folders = [f"{path}/gen={manifest.held[b][0]}/bucket={b}" for b in sorted(buckets) if b in manifest.held]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def _deltas(spark: SparkSession, path: str, keys: tuple[str, ...], after: int, before: int) -> DataFrame:
    stored = _read(spark, f"{path}/delta", f"{_key_columns(keys)}, _h bigint, batch_id bigint, bucket int")
    return stored.where((F.col("batch_id") > after) & (F.col("batch_id") < before))


def known_keys(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, keys: tuple[str, ...] = KEYS
               ) -> DataFrame:
    """Keys of earlier batches among which those of ``rows`` must be looked for.

    All of a bucket of the base is left out if its filter knows none of the batch's keys.
    """
    manifest = read_manifest(spark, path)
    recent = _deltas(spark, path, keys, manifest.through if manifest else -1, batch_id)
    folders = manifest.folders if manifest else BUCKETS
    hashed = _hashed(rows.select(*keys), keys, folders)
    touched = [r.bucket for r in hashed.select("bucket").distinct().collect()]  # one row a folder
    # batches recorded before the last compaction may have gone to fewer folders
    earlier = {b % (BUCKETS << k) for b in touched for k in range((folders // BUCKETS).bit_length())}
    recent = recent.where(F.col("bucket").isin(sorted(earlier))).select(*keys)
    if manifest is None:
        return recent
    words = _of_buckets(spark, f"{path}/bloom", "part int, word int, bits bigint", manifest, touched).select(
        F.coalesce("part", "bucket").alias("_part"), F.col("word").alias("_word"), "bits")
    probed = _with_probes(hashed, manifest.buckets, manifest.filter_words)
    found = probed.join(words, (F.col("part") == F.col("_part")) & (F.col("word") == F.col("_word")), "left")
    may_be = found.groupBy("bucket", "_h").agg(
        F.min((F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.col("mask")) != 0).cast("int")).alias("all"))
    hit = [r.bucket for r in may_be.where("all = 1").select("bucket").distinct().collect()]
    base = _of_buckets(spark, f"{path}/base", f"{_key_columns(keys)}, _h bigint, batch_id bigint", manifest, hit)
    return base.where(F.col("batch_id") < batch_id).select(*keys).unionByName(recent)


def unseen(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``rows`` whose key no earlier batch brought; a key stands in them once."""
    rows = materialize(rows, "batch")
    return rows.join(known_keys(spark, path, rows, batch_id, keys), list(keys), "left_anti")


def record(spark: SparkSession, path: str, rows: DataFrame, batch_id: int, keys: tuple[str, ...] = KEYS) -> None:
    """Store the keys that a batch brought, in place of what it stored before."""
    manifest = read_manifest(spark, path)
    hashed = _hashed(rows.select(*keys), keys, manifest.folders if manifest else BUCKETS)
    hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/batch_id={batch_id}")


def seed(spark: SparkSession, path: str, published: DataFrame, keys: tuple[str, ...] = KEYS,
         keys_per_bucket: int = KEYS_PER_BUCKET) -> None:
    """A store for keys that were published before there was one, ``(*keys, batch_id)``."""
    last = published.agg(F.max("batch_id")).first()[0]
    if last is not None:
        _fold(spark, path, published.select(*keys, "batch_id"), None, last, keys, keys_per_bucket)


def compact(spark: SparkSession, path: str, before: int, keys: tuple[str, ...] = KEYS,
            keys_per_bucket: int = KEYS_PER_BUCKET) -> None:
    """Fold the deltas of batches before ``before`` into the base, and drop what nothing names any more."""
    manifest = read_manifest(spark, path)
    through = manifest.through if manifest else -1
    deltas = _deltas(spark, path, keys, through, before)
    last = deltas.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    _fold(spark, path, deltas.select(*keys, "batch_id"), manifest, last, keys, keys_per_bucket)
    _drop(spark, path, through, manifest)


def _fold(spark: SparkSession, path: str, fresh: DataFrame, manifest: Manifest | None, through: int,
          keys: tuple[str, ...], keys_per_bucket: int) -> None:
    total = fresh.count() + (sum(n for _, n in manifest.held.values()) if manifest else 0)
    buckets = manifest.buckets if manifest else BUCKETS
    while total > buckets * keys_per_bucket:
        buckets *= 2
    folders = manifest.folders if manifest else BUCKETS
    while folders < buckets and (folders < FOLDERS or total > folders * KEYS_PER_FOLDER):
        folders *= 2
    words = 1 + keys_per_bucket * BITS_PER_KEY // 64
    hashed = _hashed(fresh, keys, folders)
    kept: dict[int, tuple[int, int]] = {}
    if manifest:
        same = (buckets, folders, words) == (manifest.buckets, manifest.folders, manifest.filter_words)
        touched = {r.bucket for r in hashed.select("bucket").distinct().collect()} if same else set(manifest.held)
        kept = {b: v for b, v in manifest.held.items() if same and b not in touched}
        old = _of_buckets(spark, f"{path}/base", f"{_key_columns(keys)}, _h bigint, batch_id bigint", manifest, touched)
        hashed = hashed.unionByName(_hashed(old.select(*keys, "batch_id"), keys, folders))
    merged = hashed.groupBy(*keys, "_h", "bucket").agg(F.min("batch_id").alias("batch_id"))
    gen = manifest.gen + 1 if manifest else 0
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/gen={gen}")
    written = _read(spark, f"{path}/base/gen={gen}", f"{_key_columns(keys)}, _h bigint, batch_id bigint, bucket int")
    filters = _with_probes(written, buckets, words).groupBy("bucket", "part", "word").agg(F.bit_or("mask").alias("bits"))
    filters.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bloom/gen={gen}")
    counts = {r.bucket: (gen, r["n"]) for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(gen, buckets, folders, words, through, b, g, n) for b, (g, n) in sorted((kept | counts).items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _drop(spark: SparkSession, path: str, through: int, previous: Manifest | None) -> None:
    """Remove deltas folded by the compaction before this one, and generations that neither names."""
    now = read_manifest(spark, path)
    named = {g for m in (now, previous) if m for g, _ in m.held.values()}
    remove_partitions(spark, f"{path}/delta", lambda batch: batch <= through)
    for folder in ("base", "bloom"):
        remove_partitions(spark, f"{path}/{folder}", lambda gen: gen not in named and gen < now.gen)
