"""Sums and numbers along an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calamus.session import broadcast_if_small, materialize


def running_sums(df: DataFrame, bucket: Column, order: list[Column], group: list[str] | None = None, **sums: Column) -> DataFrame:
    """Inclusive running sums, one per keyword, in the order (bucket, order) within `group`. Sums per bucket are made first;
    their running totals, one row per group and bucket, are joined back to sums made inside each bucket."""
    group = group or []
    keyed = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        keyed = keyed.withColumn(f"_v_{name}", value)
    totals = keyed.groupBy(*group, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        keyed = keyed.withColumn(f"_i_{name}", F.sum(f"_v_{name}").over(inside))
    joined = keyed.join(broadcast_if_small(offsets), [*group, "_bucket"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_o_{name}") + F.col(f"_i_{name}"))
    return joined.drop("_bucket", *[f"_{k}_{n}" for n in sums for k in "voi"])


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 0 in the order of columns that tell all rows apart: a range-partitioned sort, written once, then
    the numbers of rows in the partitions before (one row per partition) added to the place in the own one."""
    rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_part", part).join(broadcast_if_small(offsets), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before", "_at")
