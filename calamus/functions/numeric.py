"""Arithmetic expressions that are safe under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """a / b where b > 0; else NULL, or what is given."""
    out = F.when(b > 0, a / b)
    return out if otherwise is None else out.otherwise(otherwise)


def logaddexp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b), the larger one taken out first."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that it is not evaluated for every mention."""
    return F.transform(F.array(value), body)[0]


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of e^x over an array of doubles, shifted by its maximum; NULL for an empty array."""
    return let(F.array_max(values), lambda m: m + F.ln(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))


def log_sum_exp_by(df: DataFrame, by: list[str], value: str, name: str = "logsum") -> DataFrame:
    """The same over rows: a maximum and a sum per group."""
    top = df.groupBy(*by).agg(F.max(value).alias("_top"))
    return df.join(top, by).groupBy(*by).agg((F.max("_top") + F.ln(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias(name))


def percent(x: Column) -> Column:
    """A share as percent with one decimal."""
    return F.format_string("%.1f", x * 100)


def linspace(lo: float, hi: float, n: int) -> list[int]:
    """n evenly spaced numbers from lo to hi, both included, truncated to whole numbers."""
    return [int(lo + (hi - lo) * i / (n - 1)) if n > 1 else int(lo) for i in range(n)]
