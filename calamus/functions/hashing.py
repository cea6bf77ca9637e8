"""Keyed hashing: reproducible draws that any engine with MD5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that make a number: 60 bits, so that it fits a BIGINT.
DIGITS = 15


def key(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by `|`; strings and numbers are literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A number in [0, n) from 60 bits of `key`; NULL where n is 0."""
    value = F.conv(F.substring(key(*parts), 1, DIGITS), 16, 10).cast("bigint")
    return F.when(n > 0, value % n)


def cumulative(df: DataFrame, order: str, value: Column, name: str, digits: int = 3, within: tuple[str, ...] = ()) -> DataFrame:
    """Sum of `value` over the rows before each row, in the order of the hex hash column `order` (ties must not occur),
    within groups if named. No task sees a whole group: sums are made per hash prefix (at most 16^digits a group), those
    are added up, and rows are summed inside their prefix."""
    keyed = df.withColumn("_bucket", F.substring(order, 1, digits)).withColumn("_value", value)
    sums = keyed.groupBy(*within, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*within, "_bucket", F.coalesce(F.sum("_sum").over(before(*within).orderBy("_bucket")), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("_value").over(before(*within, "_bucket").orderBy(order)), F.lit(0))
    return keyed.withColumn("_inside", inside).join(offsets, [*within, "_bucket"]).withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint")).drop("_bucket", "_value", "_inside", "_offset")


def positions(df: DataFrame, order: str, name: str = "pos", digits: int = 3, within: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive positions from 0 in the order of a hash column, as `cumulative` makes them."""
    return cumulative(df, order, F.lit(1), name, digits, within)
