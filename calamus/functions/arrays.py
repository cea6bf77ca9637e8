"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, keep: list[str], array: Column | str, name: str) -> DataFrame:
    """One row per element that is not NULL, with the columns `keep`. A plain `explode` lets the optimizer infer a filter on
    the array's size, which evaluates whatever built the array a second and third time; the outer form does not."""
    array = F.col(array) if isinstance(array, str) else array
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
