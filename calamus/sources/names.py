"""Metadata held in file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.functions.ordering import numbered


def seven_fields(files: DataFrame) -> DataFrame:
    """(file_name, scribe, text_id, village, date, new_name) of names with exactly seven `_` fields: text id, date, village,
    scribe and three more. The scribe is capitalised and loses its dots; other names give no row."""
    parts = F.split("file_name", "_")
    scribe = F.replace(F.concat(F.upper(F.substring(parts[3], 1, 1)), F.lower(F.expr("substring(split(file_name, '_')[3], 2)"))), F.lit("."), F.lit(""))
    fields = files.where(F.size(parts) == 7).select("file_name", scribe.alias("scribe"), parts[0].alias("text_id"), parts[2].alias("village"), parts[1].alias("date"))
    return fields.withColumn("new_name", F.concat_ws("_", "scribe", "text_id", "village", "date"))


def dash_fields(files: DataFrame) -> DataFrame:
    """(file_name, name, text_id, new_name) of names parted by `-`: field 3 capitalised and field 0. A name too short for a
    fourth field gives no row."""
    parts = F.split("file_name", "-")
    name = F.concat(F.upper(F.substring(parts[3], 1, 1)), F.lower(F.expr("substring(split(file_name, '-')[3], 2)")))
    return files.where(F.size(parts) >= 4).select("file_name", name.alias("name"), parts[0].alias("text_id")).withColumn("new_name", F.concat_ws("_", "name", "text_id"))


def index_names(files: DataFrame) -> DataFrame:
    """(file_name, author, title, new_name): file k in the order of names becomes author k, title k."""
    k = F.col("_k").cast("string")
    return numbered(files.select("file_name").distinct(), "_k", "file_name").select("file_name", k.alias("author"), k.alias("title"), F.concat(k, F.lit("_"), k, F.lit(".txt")).alias("new_name"))
