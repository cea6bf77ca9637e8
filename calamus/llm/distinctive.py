"""Problem 1: how distinctive a term is of its record, by log-entropy weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calamus.llm.records import record_counts
from calamus.session import BROADCAST_ROWS, materialize, small_enough


def log_entropy(corpus: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", heavy_share: float = 0.01) -> DataFrame:
    """Score every term of every record: `ln(1 + tf) * (1 - H / ln N)`, H the entropy of the term's spread over records.

    Two aggregations: (record, term) gives tf, inside the record's row, then term gives cf, df and H = ln cf - sum(tf ln tf) / cf. The weights go
    back to the rows by a join on the term; terms held by more than `heavy_share` of the records (at most the mean number
    of terms in a record, divided by that share, whatever the corpus' size) are counted and broadcast, so that no task
    gets a hot term, the rest is joined by shuffle.

    Columns: the id, term, tf, length (terms of the record), cf, df, n_records, n_terms, score.
    Defined results: records with NULL tokens take no part; a record without terms counts as a record and yields no row;
    repeated records count once; one record in all gives score 0 (there is no spread); an empty table gives no row. Other
    columns of the input, whatever their names, are ignored.
    """
    counts = materialize(record_counts(corpus, id_col, tokens_col), "p1-counts")
    tf = F.col("tf").cast("double")
    found = counts.where(F.col("term").isNotNull())
    stats = materialize(
        found.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"), F.sum(tf * F.ln(tf)).alias("_tlnt")), "p1-terms"
    )
    whole = counts.agg(F.sum(F.col("head").cast("bigint")).alias("n"), F.sum("tf").alias("terms")).first()
    n, n_terms = whole["n"] or 0, whole["terms"] or 0
    cf = F.col("cf").cast("double")
    entropy = F.greatest(F.ln(cf) - F.col("_tlnt") / cf, F.lit(0.0))
    weight = F.greatest(1 - entropy / math.log(n), F.lit(0.0)) if n > 1 else F.lit(0.0)
    weights = stats.select("term", "cf", "df", weight.alias("_weight"))
    line = heavy_share * n
    heavy = weights.where(F.col("df") > line)
    if small_enough(heavy, BROADCAST_ROWS):
        marked = found.join(F.broadcast(heavy), "term", "left")
        own = marked.where(F.col("df").isNotNull())
        rest = marked.where(F.col("df").isNull()).drop("cf", "df", "_weight").join(weights.where(F.col("df") <= line), "term")
        joined = own.unionByName(rest)
    else:
        joined = found.join(weights, "term")
    return joined.select(
        F.col("_id").alias(id_col), "term", "tf", "length", "cf", "df", F.lit(n).cast("bigint").alias("n_records"),
        F.lit(n_terms).cast("bigint").alias("n_terms"), (F.log1p(F.col("tf").cast("double")) * F.col("_weight")).alias("score"),
    )


def marking_terms(corpus: DataFrame, min_tf: int = 5, lift: int = 10, min_df: int = 2, max_share: int = 20) -> DataFrame:
    """(doc_id, term) where the term occurs at least `min_tf` times, has at least `lift` times the share of the record it
    has of the corpus, and is held by `min_df` to 1/`max_share` of the records.

    Candidates come by score: a term in at most N/max_share records has an entropy of at most the logarithm of that
    number, so its score cannot be lower than the bound used; whole-number comparisons then decide. (They imply the bound,
    so it removes no row that they keep.)
    """
    scored = log_entropy(corpus)
    n = F.col("n_records")
    spread = F.greatest(F.ln(n / F.lit(max_share)) / F.ln(n.cast("double")), F.lit(0.0))
    bound = F.when(n > max_share, math.log1p(min_tf) * (1 - spread) - 1e-9).otherwise(F.lit(0.0))
    return scored.where(
        (F.col("tf") >= min_tf)
        & (F.col("score") >= bound)
        & (F.col("df") >= min_df)
        & (F.col("df") * max_share <= n)
        & (F.col("tf").cast("decimal(18,0)") * F.col("n_terms").cast("decimal(18,0)") >= F.col("cf").cast("decimal(18,0)") * F.col("length").cast("decimal(18,0)") * lift)
    ).select("doc_id", "term")
