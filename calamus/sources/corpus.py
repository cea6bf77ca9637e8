"""Corpus scans: files named author_title, and the driver's record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calamus.functions import text as T
from calamus.functions.ordering import numbered
from calamus.session import materialize, small_enough


def author_of(name: Column) -> Column:
    """The file name up to its first `_`; NULL where it has none."""
    return F.when(F.instr(name, "_") > 0, F.split(name, "_", 2)[0])


def title_of(name: Column) -> Column:
    """What follows the first `_` (the whole name where there is none), `.txt` taken out."""
    rest = F.when(F.instr(name, "_") > 0, F.split(name, "_", 2)[1]).otherwise(name)
    return F.replace(rest, F.lit(".txt"), F.lit(""))


def number_unknown(docs: DataFrame, path: str) -> DataFrame:
    """Documents without an author get the numbers 0, 1, ... as authors, in the order of their paths."""
    named = docs.where(F.col("author").isNotNull())
    unknown = numbered(docs.where(F.col("author").isNull()), "_n", path).withColumn("author", F.col("_n").cast("string")).drop("_n")
    return named.unionByName(unknown.select(*named.columns))


def read_corpus(spark: SparkSession, directory: str, text_cutoff: int | None = None) -> DataFrame:
    """(path, author, title, tokens) of a directory with one UTF-8 text per file. Only the base name is looked at, so an
    underscore in a directory changes nothing. Tokens are cut to the first `text_cutoff`
    only where that is given."""
    files = spark.read.format("text").option("wholetext", True).load(directory).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.element_at(F.split("path", "/"), -1)
    tokens = T.tokenize(F.col("value"))
    cut = tokens if text_cutoff is None else F.slice(tokens, 1, text_cutoff)
    docs = files.select("path", author_of(name).alias("author"), title_of(name).alias("title"), cut.alias("tokens"))
    return number_unknown(docs, "path")


def records(corpus: DataFrame) -> DataFrame:
    """(doc_id, author, title, words) of the driver's corpus table: records delivered again once, authors trimmed and in
    upper case; records without an author, a title or tokens are left out."""
    c = corpus.where(F.col("tokens").isNotNull() & F.col("author").isNotNull() & F.col("title").isNotNull())
    flat = c.select("doc_id", F.upper(F.trim("author")).alias("author"), "title", F.array_join("tokens", " ").alias("_text"))
    once = flat.dropDuplicates(["doc_id"])
    return once.select("doc_id", "author", "title", T.tokenize(F.col("_text")).alias("words"))


def lean_records(corpus: DataFrame) -> DataFrame:
    """The same rows; only records delivered again are shuffled, as long as their ids are few enough to broadcast."""
    c = corpus.where(F.col("tokens").isNotNull() & F.col("author").isNotNull() & F.col("title").isNotNull()).select("doc_id", "author", "title", "tokens")
    again = materialize(c.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not small_enough(again):
        return records(corpus)
    known = F.broadcast(again.where("doc_id is not null"))
    once = c.where("doc_id is not null").join(known, "doc_id", "left_anti")
    rest = c.join(known, "doc_id", "left_semi").unionByName(c.where("doc_id is null")).dropDuplicates(["doc_id"])
    named = lambda df: df.select("doc_id", F.upper(F.trim("author")).alias("author"), "title", T.tokenize(F.array_join("tokens", " ")).alias("words"))
    return named(once).unionByName(named(rest))


def chunk_files(works: DataFrame, size: int = 1000) -> DataFrame:
    """(name, n, text): works cleaned for Latin and cut into full chunks of `size` words, numbered from 1."""
    bare = F.replace(F.col("file_name"), F.lit(".txt"), F.lit(""))
    parts = works.where("text is not null and file_name is not null").select(bare.alias("name"), T.chunks(T.latin_words(F.col("text")), size).alias("parts"))
    return parts.select("name", F.posexplode_outer("parts").alias("n", "text")).where("n is not null").withColumn("n", F.col("n") + 1)
