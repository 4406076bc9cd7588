"""Expressions with named intermediate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = tuple[str, dict[str, str]]


def let(values: dict[str, Column], steps: list[Step], result: str) -> Column:
    """``result`` (SQL) over the columns ``v.name`` and the values of earlier steps.

    Each step ``(s, {name: sql})`` makes ``s.name`` available to what follows. A value used
    many times is computed once per row, and the plan holds its expression once: Spark would
    otherwise copy it into every place that mentions it. Written as one-element lambdas.
    """
    text = result
    for name, fields in reversed(steps):
        listed = ", ".join(f"'{k}', {sql}" for k, sql in fields.items())
        text = f"transform(array(named_struct({listed})), {name} -> {text})[0]"
    bound = F.array(F.struct(*[col.alias(k) for k, col in values.items()]))
    return F.get(F.call_function("transform", bound, F.expr(f"v -> {text}")), F.lit(0))


def computed(df: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """``keep`` and ``fields``, each field computed once per row however often it is used.

    Spark pushes a later filter below a projection by copying the expressions it mentions; a
    generator in between stops that.
    """
    row = F.struct(*[col.alias(name) for name, col in fields.items()])
    return df.select(*keep, F.inline(F.array(row)))
