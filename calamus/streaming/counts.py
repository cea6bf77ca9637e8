"""A corpus that arrives as a stream: records once, counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calamus.functions.text import tokenize


def read_stream(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """New Parquet files of a directory as they come."""
    return spark.readStream.schema(schema).parquet(directory)


def record_counts(stream: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", time_col: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """(id, n_words, time) of each record once: later deliveries of an id are dropped within the watermark, and its state with
    them. Rows without id, time or tokens take no part."""
    rows = stream.where(F.col(id_col).isNotNull() & F.col(tokens_col).isNotNull() & F.col(time_col).isNotNull())
    once = rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return once.select(id_col, F.size(tokenize(F.array_join(tokens_col, " "))).cast("bigint").alias("n_words"), time_col)


def daily_totals(stream: DataFrame, time_col: str = "loaded_at", late: str = "1 day", **columns: str) -> DataFrame:
    """(day, records, words): tumbling days of arrival, finished once the watermark has passed them."""
    counts = record_counts(stream, time_col=time_col, late=late, **columns)
    each = counts.groupBy(F.window(time_col, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("records"), F.sum("n_words").alias("words"))
    return each.select(F.col("w.start").alias("day"), "records", "words")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is, into a memory table, then stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
