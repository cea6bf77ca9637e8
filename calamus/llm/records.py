"""What the operators share: records delivered again, counts inside records, and sums along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.text import run_count, run_term, runs, tokenize
from calamus.session import materialize, small_enough


def record_counts(corpus: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(_id, head, length, term, tf): the different terms of every record that has a token list, and how often each occurs.

    Terms are counted inside their row, so neither texts nor counts are shuffled. A record without terms has one row with
    a NULL term; `head` marks one row per record. Records delivered again count once, NULL ids and NULL lists take no part.
    """
    rows = once(corpus.where(F.col(tokens_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(tokens_col).alias("_tokens")), "_id")
    terms = rows.select("_id", tokenize(F.array_join("_tokens", " ")).alias("_terms"))
    counted = terms.select("_id", F.size("_terms").cast("bigint").alias("length"), runs(F.col("_terms")).alias("_runs"))
    each = counted.select("_id", "length", F.posexplode_outer("_runs").alias("_at", "_run"))
    each = each.select("_id", (F.coalesce("_at", F.lit(0)) == 0).alias("head"), "length", run_term(F.col("_run")).alias("term"), "_run")
    return each.select("_id", "head", "length", "term", run_count(F.col("_run"), F.col("term")).alias("tf"))


def once(df: DataFrame, id_col: str) -> DataFrame:
    """One row per id; rows with a NULL id are left out. Only rows whose id occurs again are shuffled, as long as a count
    shows that these ids are few enough to broadcast; else all rows are."""
    known = df.where(F.col(id_col).isNotNull())
    again = materialize(known.groupBy(id_col).count().where(F.col("count") > 1).select(id_col), "repeated")
    if not small_enough(again):
        return known.dropDuplicates([id_col])
    single = known.join(F.broadcast(again), id_col, "left_anti")
    return single.unionByName(known.join(F.broadcast(again), id_col, "left_semi").dropDuplicates([id_col]))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of `value` in the order (bucket, order) within `group`, without a task that sees a whole
    group: sums per bucket are made first, their running totals (one row per group and bucket) are joined back."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*group, bucket])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )
