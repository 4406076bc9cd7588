"""Reading results in tests."""

from __future__ import annotations


def rows_of(df, *columns, order=("page_seq", "pos")):
    return [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]
