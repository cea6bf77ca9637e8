"""Term counts, vocabularies and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calamus.functions.arrays import elements
from calamus.functions.text import char_ngrams


def term_counts(docs: DataFrame, words: Column | str = "words") -> DataFrame:
    """(doc_id, term, tf)."""
    words = F.col(words) if isinstance(words, str) else words
    return elements(docs, ["doc_id"], words, "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def ngram_counts(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, term, tf) over character n-grams of the words."""
    return term_counts(docs, char_ngrams(F.col("words"), n))


def vocabulary(counts: DataFrame, k: int | None, min_df: int = 2, binary: bool = False) -> DataFrame:
    """(term, cf, df): terms in at least `min_df` documents, the `k` with the highest corpus frequency; with `binary`
    document frequency ranks, since counts are cut to 1 first. Ties go to the smaller term. At most k rows;
    all with k None."""
    each = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return each if k is None else each.orderBy(F.desc("df" if binary else "cf"), "term").limit(k)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row per phase: words, different words, authors, documents, and ordered pairs by the same and by different authors.
    Pairs are counted from authors' document numbers, never built."""
    words = docs.groupBy("phase").agg(F.sum(F.size("words")).alias("total_words"), F.count_distinct("author").alias("authors"), F.count(F.lit(1)).alias("docs"))
    unique = elements(docs, ["phase"], "words", "w").distinct().groupBy("phase").agg(F.count(F.lit(1)).alias("unique_words"))
    same = docs.groupBy("phase", "author").agg(F.count(F.lit(1)).alias("c")).groupBy("phase").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("sadps"))
    out = words.join(unique, "phase", "left").join(same, "phase")
    return out.select("phase", "total_words", F.coalesce("unique_words", F.lit(0)).alias("unique_words"), "authors", "docs", "sadps", (F.col("docs") * (F.col("docs") - 1) - F.col("sadps")).alias("dadps"))


def author_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("author").agg(F.count(F.lit(1)).alias("docs"))
