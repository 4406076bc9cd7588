"""Session settings, shared scratch tables and joins of measured size."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest file size of a table that is broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def build_session(app: str = "syndica", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans rely on: UTC, AQE and skew-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster
    such a folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="syndica-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own scratch folder."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{scratch_dir(spark)}/syndica/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a columnar copy, so that several readers share one
    computation, each reads only its columns, and a lost executor costs no
    recomputation of what lies before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    if partition_by:
        fields = [f for f in schema.fields if f.name != partition_by]
        schema = type(schema)(fields + [schema[partition_by]])
    return spark.read.schema(schema).parquet(path)


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside are removed when it is written, not when the driver next
    collects its garbage; the session's setting is as before afterwards."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, files = _folder(spark, path)
    return files.exists(at)


def _numbered_folders(spark: SparkSession, path: str):
    at, files = _folder(spark, path)
    for status in files.listStatus(at) if files.exists(at) else ():
        value = status.getPath().getName().partition("=")[2]
        if value.isdigit():
            yield int(value), status.getPath(), files


def partition_numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` below ``path``, in order; none if it is not there."""
    return sorted(number for number, _, _ in _numbered_folders(spark, path))


def remove_partitions(spark: SparkSession, path: str, is_old) -> None:
    """Remove the folders ``name=<number>`` below ``path`` whose number ``is_old``."""
    for number, folder, files in list(_numbered_folders(spark, path)):
        if is_old(number):
            files.delete(folder, True)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job is run); None when unknown.

    For a table that was just written it is the size of its files.
    """
    if not hasattr(df, "_jdf"):
        return None
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_measured(left: DataFrame, right: DataFrame, on, how: str = "inner",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join of page bodies with a side that should be small, without trusting that it is.

    ``right`` is written first, so its size is known and not guessed; only up to ``limit`` is
    it broadcast. Above, Spark plans a shuffled join, whose skewed keys AQE splits. Narrow
    joins need none of this: there Spark's own threshold and AQE decide.
    """
    written = materialize(right, "joined")
    size = estimated_bytes(written)
    if size is not None and size <= limit:
        written = F.broadcast(written)
    return left.join(written, on, how)


PARSE_TASKS = "spark.syndica.parseTasks"


def spread(df: DataFrame) -> DataFrame:
    """Repartition before a slow parsing step if the session setting ``PARSE_TASKS`` says so.

    Unset (the default) leaves partitions as they are, which is right for large inputs. A local
    run over small files may set it to its number of cores, as a file then is one task.
    """
    tasks = df.sparkSession.conf.get(PARSE_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The steps that run in Python are functions of the package, so workers must be able to
    import it wherever they were started.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(package):
        return
    folder = tempfile.mkdtemp(prefix="syndica-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "syndica-package"), "zip", os.path.dirname(package),
        os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
