"""Scores of pairs: min-max scaled distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.functions.numeric import ratio


def scaled(scores: DataFrame, column: str = "dist", name: str = "score") -> DataFrame:
    """`column` scaled to [0, 1] over all rows (dev and test together, if both are there); NULL where all are equal. The
    extremes are one row, joined back."""
    ends = scores.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return scores.crossJoin(F.broadcast(ends)).withColumn(name, ratio(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
