"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib
import os

import duckdb
import pytest

ENTRY = importlib.import_module("__spark_entry__")
SF_DIR = ENTRY.SMOKE_DIR
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


NAMES = sorted(importlib.import_module("workload.queries").QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) <= set(ENTRY.queries()) and set(NAMES) <= set(ENTRY.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = ENTRY.queries()[name](spark, SF_DIR)
    got = _rows(df.columns, df.collect())
    cursor = duck.execute(ENTRY.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == _rows(columns, cursor.fetchall())
