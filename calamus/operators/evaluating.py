"""Curves and figures over scored pairs (label, score): lower scores mean more alike; similarity is 1 - score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calamus.functions.numeric import ratio
from calamus.functions.ordering import running_sums


def _truth(scores: DataFrame) -> DataFrame:
    return scores.where("score is not null").select(F.round(1 - F.col("score"), 9).alias("sim"), (F.col("label") != "diff_author").cast("int").alias("y"))


def f1(p: Column, r: Column) -> Column:
    """2 P R / (P + R): the F1 value. NULL for 0/0."""
    return ratio(2 * p * r, p + r)


def _curve(scores: DataFrame) -> DataFrame:
    """Per different similarity, best first: same-author pairs (y) and pairs (n), and both summed up to there (tp, k)."""
    each = _truth(scores).groupBy("sim").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    run = running_sums(each, F.floor(-1000 * F.col("sim")), [F.desc("sim")], tp=F.col("y"), k=F.col("n"))
    run = run.crossJoin(F.broadcast(each.agg(F.sum("y").alias("all"))))  # one row
    return run.where((F.col("tp") - F.col("y") < F.col("all")) & (F.col("all") > 0))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1), one row per different similarity down to the first with recall 1. Scores are
    aggregated per similarity before they are summed up in order."""
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("all")
    return _curve(scores).select(F.col("sim").alias("threshold"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def _applied(scores: DataFrame, best: DataFrame) -> DataFrame:
    x = _truth(scores).crossJoin(F.broadcast(best))  # one row
    hit = F.col("sim") >= F.col("_best")
    s = x.agg(F.max("_best").alias("threshold"), F.sum(F.when(hit, F.col("y")).otherwise(0)).alias("tp"), F.sum(hit.cast("int")).alias("k"), F.sum("y").alias("all"))
    p, r = ratio(F.col("tp"), F.col("k"), F.lit(0.0)), ratio(F.col("tp"), F.col("all"), F.lit(0.0))
    return s.select("threshold", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def at_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """(threshold, precision, recall, f1) where pairs of at least that similarity are called same-author; precision 0 and f1
    NULL if there are none."""
    return _applied(scores, scores.sparkSession.range(1).select(F.lit(float(threshold)).alias("_best")))


def average_precision(scores: DataFrame, method: str = "trapezoid") -> DataFrame:
    """Area under the curve, from recall 0 at precision 1: by trapezoids or by steps."""
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("all")
    p0, r0 = ratio(F.col("tp") - F.col("y"), F.col("k") - F.col("n"), F.lit(1.0)), (F.col("tp") - F.col("y")) / F.col("all")  # the point before
    high = (p + p0) / 2 if method == "trapezoid" else p
    return _curve(scores).agg(F.sum((r - r0) * high).alias("ap"))


def best_point(scores: DataFrame) -> DataFrame:
    """The curve's point of maximal F1; the highest threshold of equal ones."""
    return pr_curve(scores).where("f1 is not null").orderBy(F.desc(F.round("f1", 12)), F.desc("threshold")).limit(1)


def rank_predict(scores: DataFrame, method: str = "proportional", n: int | None = None) -> DataFrame:
    """(precision, recall, f1) when the N most similar pairs are called same-author: N given (`proportional`), or the number
    of true ones (`calibrated`). `break-even-point` takes the point of maximal F1. Ties by the pair's ids."""
    if method == "break-even-point":
        return best_point(scores).select("precision", "recall", "f1")
    if method not in ("proportional", "calibrated"):
        raise ValueError(f"no such method: {method}")
    if method == "proportional" and n is None:
        raise ValueError("proportional needs n")
    x = scores.where("score is not null").select(F.round(1 - F.col("score"), 9).alias("sim"), (F.col("label") != "diff_author").cast("int").alias("y"), "i", "j")
    limit = F.lit(n) if n is not None else F.col("all")
    one = F.lit(1).cast("bigint")
    ranked = running_sums(x, F.floor(-1000 * F.col("sim")), [F.desc("sim"), F.col("i"), F.col("j")], rank=one).crossJoin(F.broadcast(x.agg(F.sum("y").alias("all"))))
    hit = F.col("rank") <= limit
    s = ranked.agg(F.sum(F.when(hit, F.col("y")).otherwise(0)).alias("tp"), F.sum(hit.cast("int")).alias("k"), F.max("all").alias("all"))
    p, r = ratio(F.col("tp"), F.col("k"), F.lit(0.0)), ratio(F.col("tp"), F.col("all"), F.lit(0.0))
    return s.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def transfer(dev: DataFrame, test: DataFrame) -> DataFrame:
    """The best threshold of the development pairs, applied to the test pairs."""
    best = best_point(dev).select(F.col("threshold").alias("_best"))
    return _applied(test, best)


def two_sample_ks(scores: DataFrame) -> DataFrame:
    """(d, n_same, n_diff, p): the largest gap between the score distributions of same- and different-author pairs, and its
    asymptotic p-value (NULL where a side is empty)."""
    each = _truth(scores).groupBy("sim").agg(F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("z"))
    run = running_sums(each, F.floor(1000 * F.col("sim")), [F.col("sim")], a=F.col("y"), b=F.col("z"))
    run = run.crossJoin(F.broadcast(each.agg(F.sum("y").alias("na"), F.sum("z").alias("nb"))))
    gap = F.abs(ratio(F.col("a"), F.col("na"), F.lit(0.0)) - ratio(F.col("b"), F.col("nb"), F.lit(0.0)))
    return run.agg(F.max(gap).alias("d"), F.max("na").alias("n_same"), F.max("nb").alias("n_diff")).withColumn("p", ks_p_value(F.col("d"), F.col("n_same"), F.col("n_diff")))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic p-value of a two-sample statistic, an alternating series cut after 100 terms."""
    en = F.sqrt(ratio(n * m, n + m))
    x = (en + 0.12 + 0.11 / en) * d
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x)
    total = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when((n > 0) & (m > 0), F.when(x > 0.05, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).otherwise(1.0))


def kde(scores: DataFrame, points: int = 21, bandwidth: float | None = None) -> DataFrame:
    """(label, x, density): Gaussian density of the scores at evenly spaced points of [0, 1]; the bandwidth of a label, if not
    given, is the deviation of its scores times n^(-1/5). NULL where all its scores are equal. The grid is `points` rows."""
    grid = scores.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("x"))
    known = scores.where("score is not null").select("label", "score")
    if bandwidth is None:
        width = F.stddev_samp("score") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))
    else:
        width = F.lit(float(bandwidth))
    wide = known.groupBy("label").agg(width.alias("_h"))  # one row per label
    each = known.join(F.broadcast(wide), "label").crossJoin(F.broadcast(grid))
    z = ratio(F.col("x") - F.col("score"), F.col("_h"))
    return each.groupBy("label", "x").agg(ratio(F.avg(F.exp(-z * z / 2)), F.max("_h") * math.sqrt(2 * math.pi)).alias("density"))
