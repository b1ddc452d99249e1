"""Small Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday(date: str | Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(col(date))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed seconds expressed in minutes; negative when end precedes start."""
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(60.0)


def is_finite(c: str | Column) -> Column:
    c = col(c)
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def band(value: str | Column, low: str | Column, high: str | Column) -> Column:
    """0, 1 or 2; a value equal to a limit belongs to the lower band."""
    v = col(value)
    return F.when(v <= col(low), 0).when(v <= col(high), 1).otherwise(2)


def all_close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Asymmetric closeness: |a-b| <= atol + rtol*|b|."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def is_close(a: str | Column, b: str | Column, rtol: float = 1e-7, atol: float = 2e-6) -> Column:
    """Symmetric closeness: |a-b| <= max(rtol*max(|a|,|b|), atol)."""
    a, b = col(a), col(b)
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= F.greatest(F.lit(rtol) * scale, F.lit(atol))


def pairs(n: str | Column) -> Column:
    """Number of unordered pairs among n members."""
    n = col(n).cast("double")
    return n * (n - 1) / 2


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def melt(df: DataFrame, ids: list[str], values: dict[str, str | Column],
         name: str, value: str, dtype: str = "double") -> DataFrame:
    """Wide columns to (name, value) rows without a shuffle."""
    cells = F.array(*[
        F.struct(F.lit(label).alias(name), col(c).cast(dtype).alias(value))
        for label, c in values.items()
    ])
    return df.select(*ids, F.inline(cells))
