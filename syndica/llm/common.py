"""Column picking, batch helpers and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.session import materialize, ship_package

MAX_ROUNDS = 60
BATCH_ROWS = 512


def place_of(df: DataFrame, name: str) -> int:
    """Which column ``name`` means: an exact name wins over one that differs in case, the first
    of equal names over later ones."""
    same = [i for i, n in enumerate(df.columns) if n == name]
    same = same or [i for i, n in enumerate(df.columns) if n.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named by place, ``_c0`` and so on, so that none can clash."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of at most ``rows``, without copies.

    Spark's default of 10,000 texts, made into Python objects at once, costs a worker several times
    their bytes. The session's own batch size stays as it is.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def sliced_udf(fn: Callable[..., list], returns: str, rows: int = BATCH_ROWS) -> Callable[..., Column]:
    """A column function out of ``fn``, which takes lists of a few rows' values and gives a list.

    What ``fn`` gives leaves the worker at once: a batch's results together, texts above all, would cost it
    and the executor several times their bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(returns))  # asks the session, which tasks have not

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), rows):
                yield pa.array(fn(*(c.slice(at, rows).to_pylist() for c in columns)), kind)
            del columns
            pa.default_memory_pool().release_unused()

    @F.arrow_udf(returns)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((a,) for a in batches)

    @F.arrow_udf(returns)
    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)

    return lambda *columns: (one, two)[len(columns) - 1](*columns)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``new=old``; other columns cannot clash with anything later."""
    ship_package(df.sparkSession)
    return numbered(df).select(*[F.col(f"_c{place_of(df, old)}").alias(new) for new, old in columns.items()])


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches as plain column lists; a narrow step without a shuffle."""
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in sliced(batches):
            made = fn({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def crc_of(column: Column) -> Column:
    """CRC-32 of a value as text, as the learn / held-out split defines it."""
    return F.crc32(column.cast("string").cast("binary"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b",
                         name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges``: the smallest node it can reach.

    Alternating large-star and small-star steps: every step is one partial minimum by node and
    one join, so that a hub costs no task more than its share of edges (AQE splits the join),
    and the number of rounds grows with the logarithm of the graph. Every round is written to
    the shared folder, so a lost executor repeats one round at most. Edges with a NULL end
    are ignored; an empty table gives no rows.
    """
    x, y = F.col(a), F.col(b)
    links = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    links = materialize(links, f"{name}-links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = materialize(_small_star(_large_star(links)), f"{name}-round")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def meet_in_chunks(entries: DataFrame, key: str, member: str, max_list: int) -> DataFrame:
    """Rows of ``entries`` dealt so that every two members of a ``key`` meet in one run of rows
    with equal ``(key, i, j)``; lists longer than ``max_list`` are cut into chunks, of which
    every two (and each with itself) make a run. ``own`` is the row's chunk. Keys with one row are left out.
    """
    counts = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col(key).alias("_key"), F.ceil(F.col("_n") / max_list).cast("int").alias("_chunks"))
    listed = entries.join(counts, F.col(key) == F.col("_key")).withColumn(
        "own", F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int"))
    listed = listed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select(
        *entries.columns, "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))
    return listed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", member)


def runs_of(batches, keys: tuple[str, ...]):
    """Lists of rows with equal ``keys`` out of sorted pandas batches, none cut by a batch's end;
    one list of runs per batch."""
    from itertools import groupby
    from operator import attrgetter

    held: list = []
    for frame in batches:
        rows = held + list(frame.itertuples(index=False))
        whole = [list(g) for _, g in groupby(rows, key=attrgetter(*keys))]
        held = whole.pop() if whole else []
        yield whole
    yield [held] if held else []


def smallest_reached(n: int, pairs) -> list[int]:
    """Smallest index that each of ``n`` reaches by ``pairs`` of indexes (union-find)."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]
