"""Five distances between documents as sums over shared terms.

All are functions of per-document sums (of values, of squares, number of terms) and of four sums over the terms two
documents share, so one equality join on the term serves every metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calamus.functions.numeric import ratio
from calamus.session import broadcast_if_small, materialize

Parts = dict[str, Column]


def _minmax(p: Parts) -> Column:
    most = p["s1i"] + p["s1j"] - p["mn"]
    return F.greatest(F.lit(0.0), ratio(most - p["mn"], most, F.lit(0.0)))


def _euclidean(p: Parts) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.round(p["s2i"] + p["s2j"] - 2 * p["dot"], 12)))


def _cityblock(p: Parts) -> Column:
    return F.greatest(F.lit(0.0), p["w1i"] + p["w1j"] - 2 * p["wmn"])


def _cosine(p: Parts) -> Column:
    norms = F.sqrt(p["s2i"] * p["s2j"])
    return F.when(norms > 0, F.greatest(F.lit(0.0), 1 - ratio(p["dot"], norms)))


def _divergence(p: Parts) -> Column:
    return F.greatest(F.lit(0.0), p["dv"] + 4 * (p["nzi"] + p["nzj"] - 2 * p["n"]))


#: Metrics by name: add an entry to plug in another.
METRICS: dict[str, Callable[[Parts], Column]] = {"minmax": _minmax, "euclidean": _euclidean, "cityblock": _cityblock, "cosine": _cosine, "divergence": _divergence}


def sums(dtm: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, nz): sum, sum of squares and number of values of each document with any."""
    return dtm.groupBy("doc_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count(F.lit(1)).cast("double").alias("nz"))


def shared(a: Column, b: Column, times: Column | None = None) -> list[Column]:
    """Aggregates over the terms two documents share; `times` counts a term that often (cityblock never does)."""
    m = F.lit(1.0) if times is None else times
    dv = F.pow(2 * (a - b) / (a + b), F.lit(2))
    return [F.sum(m * F.least(a, b)).alias("mn"), F.sum(m * a * b).alias("dot"), F.sum(m * dv).alias("dv"), F.sum(m).alias("n")]


def measure(parts: DataFrame, *metrics: str) -> DataFrame:
    """Distances from columns i, j, mn, dot, dv, n, s1i, s1j, s2i, s2j, nzi, nzj (NULL for nothing shared, or an empty document)."""
    names = ["mn", "dot", "dv", "n", "s1i", "s1j", "s2i", "s2j", "nzi", "nzj"]
    p = {x: F.coalesce(F.col(x), F.lit(0.0)) for x in names}
    for whole, x in (("w1i", "s1i"), ("w1j", "s1j"), ("wmn", "mn")):
        p[whole] = F.coalesce(F.col(whole), F.lit(0.0)) if whole in parts.columns else p[x]
    return parts.select(*[c for c in parts.columns if c not in {*names, "w1i", "w1j", "wmn"}], *[METRICS[m](p).alias(m) for m in metrics])


def _sides(pairs: DataFrame, dtm: DataFrame) -> DataFrame:
    of = sums(dtm)
    for s in "ij":
        pairs = pairs.join(of.select(F.col("doc_id").alias(s), F.col("s1").alias(f"s1{s}"), F.col("s2").alias(f"s2{s}"), F.col("nz").alias(f"nz{s}")), s, "left")
    return pairs


def of_pairs(pairs: DataFrame, dtm: DataFrame, *metrics: str) -> DataFrame:
    """Distances of a pair list (columns i, j and others) whose length is a parameter: only its documents' rows are written
    out and read into the sums and into the join, on (document, term)."""
    ij = pairs.select("i", "j").distinct()
    named = ij.select(F.explode(F.array("i", "j")).alias("doc_id")).distinct()
    dtm = materialize(dtm.join(broadcast_if_small(named), "doc_id", "left_semi"), "paired")
    a = broadcast_if_small(ij).join(dtm.select(F.col("doc_id").alias("i"), "term", F.col("value").alias("a")), "i")
    met = a.join(dtm.select(F.col("doc_id").alias("j"), "term", F.col("value").alias("b")), ["j", "term"]).groupBy("i", "j").agg(*shared(F.col("a"), F.col("b")))
    return measure(_sides(pairs.join(met, ["i", "j"], "left"), dtm), *metrics)


def of_queries(pairs: DataFrame, queries: DataFrame, dtm: DataFrame, *metrics: str, spread: int = 16) -> DataFrame:
    """Distances of pairs whose first documents are all in the query set `queries` (doc_id). The query documents' terms are an
    index that all documents look up; a common term is met by nearly every document, so each is spread over `spread` parts."""
    q = dtm.join(queries.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("i"), "term", F.col("value").alias("a"))
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    d = dtm.select(F.col("doc_id").alias("j"), "term", F.col("value").alias("b")).withColumn("_part", F.pmod(F.xxhash64("j"), F.lit(spread)).cast("int"))
    met = q.join(d, ["term", "_part"]).groupBy("i", "j").agg(*shared(F.col("a"), F.col("b")))
    return measure(_sides(pairs.join(met, ["i", "j"], "left"), dtm), *metrics)
