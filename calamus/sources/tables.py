"""Result tables written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV (or TSV) with a header, UTF-8."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def read_table(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """The same table back; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The pair list: author and title of both, and whether it is a same-author pair (SADP) or not (DADP)."""
    write_table(pairs.selectExpr("author_i", "title_i", "author_j", "title_j", "case when label = 'same_author' then 'SADP' else 'DADP' end as kind"), path, "\t")


def write_distance_table(table: DataFrame, path: str) -> None:
    write_table(table, path, "\t")
