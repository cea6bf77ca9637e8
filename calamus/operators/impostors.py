"""The impostor bootstrap: how often a pair's second document beats impostors under random features."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calamus.functions.hashing import DIGITS
from calamus.functions.text import title_stem
from calamus.operators.distances import measure, of_queries
from calamus.operators.pairing import crossed
from calamus.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class Bootstrap:
    iterations: int = 10
    n_potential: int = 30
    n_actual: int | None = 10
    top_rank: int = 1
    n_features: int = 1000
    random_prop: float = 0.5
    sample_authors: bool = True
    sample_features: bool = True
    filter_authors: bool = False
    seed: int = 1066

    @property
    def actual(self) -> int:
        return self.n_actual if self.n_actual and self.n_actual < self.n_potential else self.n_potential


def potential(pairs: DataFrame, background: DataFrame, dtm: DataFrame, metric: str, how: Bootstrap) -> DataFrame:
    """(i, j, b, dist, r): each pair's nearest `n_potential` background documents to i, r from 0. Documents whose title stem is that of i or j
    are no candidates (both titles need a `_`), nor, with `filter_authors`, those by the pair's authors. Distances depend on i alone and are
    made once for each i; the number of pairs is a parameter."""
    firsts = pairs.select(F.col("i").alias("doc_id")).distinct()
    side = broadcast_if_small(pairs.select("i", "j", "author_i", "author_j", "title_i", "title_j"))
    near = of_queries(
        crossed(firsts.select(F.col("doc_id").alias("i")), background.select(F.col("doc_id").alias("j")), "i", "j"), firsts, dtm, metric
    ).select("i", F.col("j").alias("b"), F.round(metric, 9).alias("dist"))
    cand = near.join(background.select(F.col("doc_id").alias("b"), F.col("author").alias("_ab"), F.col("title").alias("_tb")), "b").join(side, "i")
    stem = title_stem(F.col("_tb"))
    for s in ("i", "j"):
        cand = cand.where(~((F.instr("_tb", "_") > 0) & (F.instr(f"title_{s}", "_") > 0) & (stem == title_stem(F.col(f"title_{s}")))))
    if how.filter_authors:
        cand = cand.where("_ab <> author_i and _ab <> author_j")
    order = Window.partitionBy("i", "j").orderBy("dist", "b")
    return cand.withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < how.n_potential).select("i", "j", "b", "dist", "r")


PARTS = "i bigint, j bigint, it int, t bigint, mn double, dot double, dv double, n double, s1i double, s2i double, nzi double, s1j double, s2j double, nzj double, w1i double, w1j double, wmn double"


def _number(n: int, *parts: object) -> int:
    """What `hashing.draw` gives for the same parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) % n


def _meetings(how: Bootstrap, n_terms: int):
    """For one pair (its first document in row -2, the second in row -1, impostors from row 0): the sums that the metrics need,
    per iteration between the first document and the second (t 0) and each impostor met t times."""
    size = int(how.random_prop * how.n_features)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("r")
        i, j, have = int(f["i"].iloc[0]), int(f["j"].iloc[0]), len(f) - 2
        v, has = np.zeros((len(f), n_terms)), np.zeros((len(f), n_terms), bool)
        for row, (idx, value) in enumerate(zip(f["idx"], f["value"], strict=True)):
            if idx is not None:
                v[row, idx], has[row, idx] = value, True
        a, b = v[0], v[1:]
        both = has[1:] & has[0]
        least = np.where(both, np.minimum(a, b), 0.0)
        gap = np.divide(2 * (a - b), a + b, out=np.zeros_like(b), where=both & (a + b > 0)) ** 2
        sums = np.stack([least, np.where(both, a * b, 0.0), gap, both.astype(float), b, b * b, has[1:].astype(float)])
        own = np.stack([a, a * a, has[0].astype(float)])
        out = []
        for it in range(how.iterations):
            met = np.ones(have, int)
            if how.sample_authors:
                met = np.bincount([_number(have, how.seed, "imp", i, j, it, d) for d in range(how.actual)], minlength=have)
            times = np.ones(n_terms)
            if how.sample_features:
                times = np.bincount([_number(n_terms, how.seed, "feat", i, j, it, x) for x in range(size)], minlength=n_terms).astype(float)
            rows = np.r_[0, 1 + np.flatnonzero(met)]
            mn, dot, dv, n, s1, s2, nz = sums[:, rows] @ times
            mine = own @ times
            out.append(pd.DataFrame({
                "i": i, "j": j, "it": it, "t": np.r_[0, met[met > 0]], "mn": mn, "dot": dot, "dv": dv, "n": n, "s1i": mine[0], "s2i": mine[1], "nzi": mine[2], "s1j": s1, "s2j": s2, "nzj": nz,
                "w1i": a.sum(), "w1j": b[rows].sum(1), "wmn": least[rows].sum(1),
            }))
        return pd.concat(out)

    return run


def sigmas(pairs: DataFrame, background: DataFrame, dtm: DataFrame, terms: DataFrame, metric: str, how: Bootstrap) -> DataFrame:
    """(i, j, label, score): sigma of every pair, 1 minus the mean reward. `terms` has (term, idx), idx from 0.

    In each iteration `actual` impostors and random_prop * n_features features are drawn, both with replacement (a feature
    drawn twice counts twice); without sampling of authors all potential impostors are met, without sampling of features
    all features count. The target's rank is 1 plus the number of impostors nearer
    to i, ties in its favour. With top_rank 1 the reward is 1 for rank 1; else 1/rank up to rank top_rank + 1 (one more
    than the name says, kept). Draws are keyed hashes: (pair, iteration, draw). A task holds one pair at a time, with the rows of
    its impostors over the vocabulary, a size that parameters bound. The work is pairs x iterations x
    impostors x shared features, so the number of pairs is a parameter.
    """
    near = potential(pairs, background, dtm, metric, how).select("i", "j", F.col("r").cast("int").alias("r"), F.col("b").alias("x"))
    near = materialize(near, "potential")
    pair = near.select("i", "j").distinct()
    every = near.unionByName(pair.select("i", "j", F.lit(-2).alias("r"), F.col("i").alias("x"))).unionByName(pair.select("i", "j", F.lit(-1).alias("r"), F.col("j").alias("x")))
    named = every.select(F.col("x").alias("doc_id")).distinct()
    rows = dtm.join(broadcast_if_small(named), "doc_id", "left_semi").join(broadcast_if_small(terms), "term")
    vectors = rows.groupBy(F.col("doc_id").alias("x")).agg(F.collect_list(F.struct("idx", "value")).alias("v"))  # at most n_features a document
    held = every.join(vectors, "x", "left").select("i", "j", "r", F.col("v.idx").alias("idx"), F.col("v.value").alias("value"))
    parts = held.groupBy("i", "j").applyInPandas(_meetings(how, terms.count()), PARTS)
    dist = measure(parts, metric).select("i", "j", "it", "t", F.round(metric, 9).alias("d"))
    target = F.max(F.when(F.col("t") == 0, F.col("d"))).over(Window.partitionBy("i", "j", "it"))
    ranks = dist.withColumn("_target", target).groupBy("i", "j", "it").agg((1 + F.sum(F.when(F.col("d") < F.col("_target"), F.col("t")).otherwise(0))).alias("rank"))
    reward = F.when(F.col("rank") == 1, 1.0).otherwise(0.0) if how.top_rank == 1 else F.when(F.col("rank") <= how.top_rank + 1, 1 / F.col("rank")).otherwise(0.0)
    score = ranks.groupBy("i", "j").agg((1 - F.sum(reward) / how.iterations).alias("score"))
    return pairs.select("i", "j", "label").join(score, ["i", "j"])
