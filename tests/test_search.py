"""Searches by blocks: against plain numpy, and without a shuffle of pairs."""

import re

import numpy as np
import pytest

from calamus.operators import counting, entropy, search, weighting
from calamus.plans import catalog


def pairs_shuffled(df):
    """Whether pairs of documents are shuffled or grouped."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"hashpartitioning\(i#\d+L?, j#|keys=\[i#\d+L?, j#", plan) is not None


def test_dist_minmax_shuffles_no_pairs(spark, sf):
    assert not pairs_shuffled(catalog.queries()["dist_minmax"](spark, sf))


def vectors(spark, n=23, terms=12):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (n, terms)) * (rng.random((n, terms)) < 0.5)
    x[5] = 0
    rows = [(k, f"A{k % 4}", f"t{k}", [f"w{t}" for t in range(terms) for _ in range(x[k, t])] + ["other", None]) for k in range(n)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    lists = search.term_lists(spark.createDataFrame(rows, "doc_id bigint, author string, title string, words array<string>"))
    return lists, [f"w{t}" for t in range(terms)], unit


def far(a, b, metric):
    either = (a + b) > 0
    return {
        "minmax": lambda: 1 - np.minimum(a, b).sum() / np.maximum(a, b).sum() if either.any() else 0.0, "euclidean": lambda: np.linalg.norm(a - b), "cityblock": lambda: np.abs(a - b).sum(),
        "cosine": lambda: 1 - a @ b if a.any() and b.any() else None, "divergence": lambda: (4 * ((a - b)[either] / (a + b)[either]) ** 2).sum(),
    }[metric]()


@pytest.mark.parametrize("metric", list(search.METRICS))
def test_distances_by_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "FEW", 2)
    lists, terms, x = vectors(spark)
    got = {(r["i"], r["j"]): r for r in search.searched(lists, terms, "doc_id % 2 = 0", metric, search.pairs(9), search.PAIRS).collect()}
    assert set(got) == {(i, j) for i in range(0, 23, 2) for j in range(23) if i != j}
    for (i, j), r in got.items():
        assert r["same"] == (i % 4 == j % 4)
        assert r["d"] == (None if far(x[i], x[j], metric) is None else pytest.approx(far(x[i], x[j], metric), abs=1e-6))


@pytest.mark.parametrize("few", [2, 16])
def test_two_blocks_meet_once(spark, monkeypatch, few):
    """Half the distances of every document to every other are computed, and no pair of blocks is left out."""
    monkeypatch.setattr(search, "FEW", few)
    lists, terms, _ = vectors(spark)
    blocks = search.packed(lists, terms, 2)
    n, got = blocks.count(), [frozenset((r["no"], r["q_no"])) for r in search.meet_once(blocks).select("no", "q_no").collect()]
    assert n >= 12 and len(got) == len(set(got)) == n * (n + 1) // 2


@pytest.mark.parametrize("metric", list(search.METRICS))
def test_every_pair_by_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "LEAST", 2)
    lists, terms, x = vectors(spark)
    got = [(r["i"], r["j"], r["same"], r["d"]) for r in search.searched(lists, terms, None, metric, search.pairs(9), search.PAIRS).collect()]
    assert sorted(r[:2] for r in got) == [(i, j) for i in range(23) for j in range(23) if i != j]
    for i, j, same, d in got:
        assert same == (i % 4 == j % 4)
        assert d == (None if far(x[i], x[j], metric) is None else pytest.approx(far(x[i], x[j], metric), abs=1e-6))


def test_dist_divergence_of_every_pair(spark, sf):
    n = catalog.docs(spark, sf).count()
    assert catalog.queries()["dist_divergence"](spark, sf).count() == n * (n - 1)


def test_dist_divergence_shuffles_no_pairs(spark, sf):
    assert not pairs_shuffled(catalog.queries()["dist_divergence"](spark, sf))


@pytest.mark.parametrize("name", ["dist_cityblock", "dist_cosine", "dist_euclidean", "distance_dense", "closest_cross_author", "distance_table"])
def test_distances_shuffle_no_pairs(spark, sf, name):
    assert not pairs_shuffled(catalog.queries()[name](spark, sf))


def test_closest_by_blocks(spark):
    lists, terms, x = vectors(spark)
    every = sorted((round(far(x[i], x[j], "minmax"), 9), i, j) for i in range(0, 23, 2) for j in range(23) if i % 4 != j % 4)
    every = [r for r in every if r[0] > 0]
    for n in (3, 40):
        got = search.searched(lists, terms, "doc_id % 2 = 0", "minmax", search.closest(n), search.CLOSEST).collect()
        assert sorted((round(r["d"], 9), r["i"], r["j"]) for r in got)[:n] == every[:n]


def test_correlations_by_blocks(spark):
    lists, terms, x = vectors(spark)
    d = np.array([[int(round(far(a, b, "minmax"), 9) * 1000) for b in x] for a in x])
    want = np.corrcoef(d[::2])
    got = {(r["a"], r["b"]): r["r"] for r in search.correlations(lists, terms, "doc_id % 2 = 0", "minmax", block=4, rows=3).collect()}
    assert len(got) == 144 and all(got[2 * a, 2 * b] == pytest.approx(want[a, b]) for a in range(12) for b in range(12))


def test_plm_cross_entropy_sorts_no_pairs(spark, sf):
    plan = catalog.queries()["plm_cross_entropy"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("terms", [2_000_000, 3])
def test_entropies_by_blocks(spark, monkeypatch, terms):
    """Several blocks of queries and of documents, the vocabulary sent or joined: as the frames of rows have it."""
    monkeypatch.setattr(entropy, "TERMS", terms)
    monkeypatch.setattr(entropy, "HELD", 8 * 23 * 5)
    lists, _, _ = vectors(spark)
    counts = search.counts(lists)
    v = counting.vocabulary(counts, None, 1)
    model = weighting.plm(weighting.restrict(counts, v, whole=True), v, 0.1, 50, None, dense=True)
    want = weighting.rank_models(weighting.cross_entropy(model.where("doc_id % 2 = 0"), model, weighting.background(v, 0.1))).collect()
    got = {(r["q"], r["doc_id"]): r for r in entropy.ranked(lists, v, "doc_id % 2 = 0").collect()}
    assert len(got) == len(want) == 12 * 23
    for r in want:
        assert got[r["q"], r["doc_id"]]["ce"] == pytest.approx(r["ce"], abs=1e-9) and got[r["q"], r["doc_id"]]["rank"] == r["rank"]
