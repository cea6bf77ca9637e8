import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calamus.functions.hashing import key, positions
from calamus.functions.numeric import linspace, log_sum_exp, log_sum_exp_by
from calamus.operators import counting, evaluating, impostors, matrix, pairing, scoring, smoothing, splitting, weighting
from calamus.operators import distances as dist

GOLD = [[2, 1, 0], [1, 0, 3], [1, 1, 0]]


def counts(spark, rows=GOLD):
    data = [(i, f"t{j}", v) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    return spark.createDataFrame(data, "doc_id bigint, term string, tf bigint")


def dense(model, n=3, m=3):
    out = np.zeros((n, m))
    for r in model.collect():
        out[r["doc_id"], int(r["term"][1])] = r["value"]
    return out


@pytest.mark.parametrize(
    ("model", "want"),
    [
        ("tf", [[0.894427, 0.447214, 0], [0.316228, 0, 0.948683], [0.707107, 0.707107, 0]]),
        ("std", [[0.924467, 0.381262, 0], [0.526247, 0, 0.850332], [0.771439, 0.636303, 0]]),
        ("tfidf", [[0.840802, 0.541343, 0], [0.193164, 0, 0.981166], [0.613356, 0.789807, 0]]),
        ("bin", [[0.707107, 0.707107, 0], [0.707107, 0, 0.707107], [0.707107, 0.707107, 0]]),
    ],
)
def test_models_golden(spark, model, want):
    assert np.allclose(dense(weighting.weigh(counts(spark), model, 3, 3, min_df=1)), want, atol=1e-6)


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        weighting.weigh(counts(spark), "idf", 3, 3)


def test_plm_golden(spark):
    c = counts(spark, [[2, 1, 0], [1, 0, 3]])
    v = counting.vocabulary(c, 3, 1)
    m = weighting.plm(weighting.restrict(c, v), v, weight=0.2, iterations=100, eps=0.01)
    got = dense(m, 2)
    assert np.allclose(got, [[0.476190, 0.523810, 0], [0, 0, 1]], atol=1e-6)
    assert np.allclose(got.sum(1), 1)


def test_vocabulary_ties_and_limits(spark):
    c = counts(spark)
    assert [r["term"] for r in counting.vocabulary(c, 2, 2).collect()] == ["t0", "t1"]
    assert counting.vocabulary(c, 9, 1).count() == 3


A, B = [3, 0, 1, 2], [1, 1, 0, 2]


def pair(spark):
    rows = [(0, f"t{k}", float(x)) for k, x in enumerate(A) if x] + [(1, f"t{k}", float(x)) for k, x in enumerate(B) if x]
    return spark.createDataFrame(rows, "doc_id bigint, term string, value double")


@pytest.mark.parametrize(("unit", "want"), [(False, [0.571429, 2.449490, 4, 0.236237, 9]), (True, [0.588990, 0.687368, 1.351019, 0.236237, 8.597334])])
def test_distances_golden(spark, unit, want):
    dtm = weighting.unit_length(pair(spark)) if unit else pair(spark)
    ij = spark.createDataFrame([(0, 1), (1, 0), (0, 0)], "i bigint, j bigint")
    got = {(r["i"], r["j"]): r for r in dist.of_pairs(ij, dtm, *dist.METRICS).collect()}
    for m, w in zip(dist.METRICS, want, strict=True):
        assert got[0, 1][m] == pytest.approx(w, abs=1e-6)
        assert got[1, 0][m] == pytest.approx(got[0, 1][m])
        assert got[0, 0][m] == pytest.approx(0, abs=1e-7)


def test_distances_of_empty_documents(spark):
    ij = spark.createDataFrame([(0, 7), (7, 8)], "i bigint, j bigint")
    got = {(r["i"], r["j"]): r for r in dist.of_pairs(ij, pair(spark), "minmax", "cosine").collect()}
    assert got[0, 7]["minmax"] == 1 and got[7, 8]["minmax"] == 0 and got[0, 7]["cosine"] is None


def test_distances_random_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (6, 20)).astype(float)
    dtm = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(6) for j in range(20) if x[i, j]], "doc_id bigint, term string, value double")
    q = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    ij = spark.createDataFrame([(i, j) for i in (0, 1) for j in range(6)], "i bigint, j bigint")
    for r in dist.of_queries(ij, q, dtm, *dist.METRICS).collect():
        a, b = x[r["i"]], x[r["j"]]
        either = (a + b) > 0
        assert r["minmax"] == pytest.approx(1 - np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=1e-9)
        assert r["euclidean"] == pytest.approx(np.linalg.norm(a - b), abs=1e-6)
        assert r["cityblock"] == pytest.approx(np.abs(a - b).sum())
        assert r["cosine"] == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
        assert r["divergence"] == pytest.approx(((2 * (a - b)[either] / (a + b)[either]) ** 2).sum(), abs=1e-9)


CURVE = [("same_author", 0.1), ("diff_author", 0.2), ("same_author", 0.4), ("diff_author", 0.6)]


def scores(spark, rows=CURVE):
    return spark.createDataFrame([(n, n + 1, a, b) for n, (a, b) in enumerate(rows)], "i bigint, j bigint, label string, score double")


def test_curve_golden(spark):
    got = [(r["threshold"], r["precision"], r["recall"]) for r in evaluating.pr_curve(scores(spark)).orderBy("threshold").collect()]
    assert np.allclose(got, [(0.6, 2 / 3, 1), (0.8, 0.5, 0.5), (0.9, 1, 0.5)])
    assert evaluating.best_point(scores(spark)).first()["f1"] == pytest.approx(0.8)
    assert evaluating.average_precision(scores(spark)).first()["ap"] == pytest.approx(0.791667, abs=1e-6)
    assert evaluating.average_precision(scores(spark), "step").first()["ap"] == pytest.approx(0.833333, abs=1e-6)


def test_thresholds_and_ranks(spark):
    t = evaluating.at_threshold(scores(spark), 0.95).first()
    assert (t["precision"], t["recall"], t["f1"]) == (0.0, 0.0, None)
    assert evaluating.rank_predict(scores(spark), "calibrated").first()["precision"] == 0.5
    assert evaluating.rank_predict(scores(spark), "proportional", 3).first()["recall"] == 1
    with pytest.raises(ValueError):
        evaluating.rank_predict(scores(spark), "proportional")
    with pytest.raises(ValueError):
        evaluating.rank_predict(scores(spark), "other")


def test_ks_golden(spark):
    rows = [("same_author", x) for x in (0.1, 0.35, 0.2)] + [("diff_author", x) for x in (0.4, 0.8, 0.2, 0.9)]
    assert evaluating.two_sample_ks(scores(spark, rows)).first()["d"] == pytest.approx(0.75)
    got = evaluating.two_sample_ks(scores(spark, rows)).first()
    en = math.sqrt(3 * 4 / 7)
    x = (en + 0.12 + 0.11 / en) * 0.75
    assert got["p"] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))


def test_scaling(spark):
    s = spark.createDataFrame([(0.2,), (0.5,), (0.8,)], "dist double")
    assert np.allclose([r["score"] for r in scoring.scaled(s).orderBy("dist").collect()], [0, 0.5, 1])
    assert scoring.scaled(spark.createDataFrame([(0.2,), (0.2,)], "dist double")).first()["score"] is None


@pytest.mark.parametrize(
    ("x", "length", "window", "want"),
    [
        ([1, 2, 3, 4, 5, 6], 3, "flat", [0.666667, 2, 3, 4, 5, 5.666667]),
        ([1, 4, 2, 8, 5, 7, 3], 5, "hanning", [1.5, 2.75, 4, 5.75, 6.25, 5.5, 4]),
        ([1, 4, 2, 8, 5, 7, 3], 4, "flat", [-0.25, 1.75, 3.75, 4.75, 5.5, 5.75, 4.5]),
    ],
)
def test_smoothing_golden(spark, x, length, window, want):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos bigint, x double")
    assert np.allclose([r["y"] for r in smoothing.smooth(s, length, window).orderBy("pos").collect()], want, atol=1e-6)


def test_smoothing_errors(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos bigint, x double")
    with pytest.raises(ValueError):
        smoothing.smooth(s, 5)
    with pytest.raises(ValueError):
        smoothing.smooth(s, 5, "box")
    assert smoothing.smooth(s, 2).count() == 2


def test_log_sum_exp(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "v array<double>")
    assert df.select(log_sum_exp(F.col("v")).alias("r")).first()["r"] == pytest.approx(9.4586297444267107)
    rows = df.select(F.lit(1).alias("g"), F.explode("v").alias("x"))
    assert log_sum_exp_by(rows, ["g"], "x").first()["logsum"] == pytest.approx(9.4586297444267107)
    assert linspace(0, 10, 3) == [0, 5, 10]


def docs(spark, n=30, authors=4):
    rows = [(i, f"A{i % authors}", f"s{i % 7}_{i}" if i % 3 else f"t{i}", [f"w{i % 5}", f"w{i % 3}", "w"]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, author string, title string, words array<string>")


def test_positions_are_a_permutation(spark):
    p = positions(docs(spark).withColumn("k", key(1, F.col("doc_id"))), "k")
    assert sorted(r["pos"] for r in p.collect()) == list(range(30))
    assert [r["doc_id"] for r in p.orderBy("pos").collect()] == [r["doc_id"] for r in p.orderBy("k").collect()]


def test_splits_keep_groups_apart(spark):
    s = splitting.split_authors(docs(spark)).select("author", "phase").distinct().collect()
    assert len(s) == 4 and {r["phase"] for r in s} == {"dev", "test"}
    assert splitting.split_random(docs(spark)).groupBy("phase").count().where("count = 15").count() == 2


def test_balanced_pairs(spark):
    rows = pairing.balanced(docs(spark), 20, True).collect()
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows) == 20
    same = [r for r in rows if r["label"] == "same_author"]
    assert len(same) == 10 and all(r["author_i"] == r["author_j"] and r["i"] != r["j"] for r in same)
    for r in rows:
        assert not ("_" in r["title_i"] and "_" in r["title_j"] and r["title_i"].split("_")[0] == r["title_j"].split("_")[0])


def test_all_pairs_there_are(spark):
    """One stem holds nearly all of an author's documents: the few eligible pairs are found, however rare."""
    rows = [(i, "A", f"book_{i}") for i in range(60)] + [(60, "A", "letter_1"), (61, "B", "book_x"), (62, "C", "plain")]
    d = spark.createDataFrame(rows, "doc_id bigint, author string, title string")
    got = pairing.balanced(d, 400, True, tries=1).collect()
    same = {(r["i"], r["j"]) for r in got if r["label"] == "same_author"}
    assert same == {(i, 60) for i in range(60)} | {(60, i) for i in range(60)}
    other = {(r["i"], r["j"]) for r in got if r["label"] != "same_author"}
    assert len(other) == len(same) and all({i, j} & {61, 62} and not ({i, j} & set(range(60)) and {i, j} & {61}) for i, j in other)
    every = {(r["i"], r["j"]) for r in pairing.drawn(d, 10**4, False).collect()}
    assert len(every) == 63 * 62


def test_balanced_without_repeating_authors(spark):
    assert pairing.balanced(docs(spark, 4, 4), 10).count() == 0


def test_against_all_is_symmetric(spark):
    d = docs(spark)
    p = {(r["i"], r["j"]) for r in pairing.against_all(d, d, block=7, spread=3).collect()}
    assert len(p) == 30 * 29 and all((j, i) in p for i, j in p)


def test_impostors_rank_in_range(spark):
    d = docs(spark, 40, 5)
    counts_ = counting.term_counts(d)
    dtm = weighting.weigh(counts_, "tf", 50, 40, min_df=1)
    terms = counting.vocabulary(counts_, 50, 1).select("term").orderBy("term").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("term string, idx bigint")
    pairs = pairing.balanced(d, 6, False)
    for top in (1, 3):
        how = impostors.Bootstrap(iterations=4, n_potential=6, n_actual=3, top_rank=top, n_features=20)
        for metric in ("minmax", "cityblock"):
            s = impostors.sigmas(pairs, d, dtm, terms, metric, how).collect()
            assert len(s) == 6 and all(0 <= r["score"] <= 1 for r in s)


def test_complete_linkage():
    merges = matrix.complete_linkage(np.array([[0.0], [1.0], [5.0], [5.5]]))
    assert merges[0][:2] == (2, 3) and merges[1][:2] == (0, 1) and merges[2][3] == 4
    assert merges[2][2] == pytest.approx(5.5)


def test_dense_table_and_back(spark):
    t = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "id_i string, id_j string, d double")
    wide = matrix.dense(t, ["a", "b"])
    assert {(r["id_i"], r["a"], r["b"]) for r in wide.collect()} == {("a", 0.0, 0.5), ("b", 0.5, 0.0)}
    assert matrix.long(wide).count() == 4


def test_corr(spark):
    t = spark.createDataFrame([(0, j, float(j)) for j in range(4)] + [(1, j, -2.0 * j) for j in range(4)], "i bigint, j bigint, d double")
    got = {(r["a"], r["b"]): r["r"] for r in matrix.correlations(t, 4).collect()}
    assert got[0, 1] == pytest.approx(-1) and got[0, 0] == pytest.approx(1)
    assert math.isclose(got[0, 1], got[1, 0])


def test_corr_of_blocks_and_missing_cells(spark):
    rnd = np.random.default_rng(2)
    cells = {(i, j): float(rnd.random()) for i in range(7) for j in range(30) if i != j and rnd.random() < 0.9}
    t = spark.createDataFrame([(i, j, d) for (i, j), d in cells.items()], "i bigint, j bigint, d double")
    full = np.array([[int(cells.get((i, j), 0.0) * 1000) for j in range(30)] for i in range(7)])
    got = {(r["a"], r["b"]): r["r"] for r in matrix.correlations(t, 30, block=2, rows=8).collect()}
    want = np.corrcoef(full)
    assert len(got) == 49 and all(got[a, b] == pytest.approx(want[a, b]) for a in range(7) for b in range(7))
