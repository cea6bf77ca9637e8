"""Whole jobs: every pair ranked, every parameter as the operator has it."""

import math

import pytest

from calamus.operators import weighting
from calamus.plans import catalog

QUERIES = catalog.queries()


def test_cross_entropy_of_every_pair(spark):
    docs = {1: {"a": 0.75, "b": 0.25}, 2: {"b": 1.0, "c": 0.0}, 3: {"c": 1.0}}
    pc = {"a": 0.3, "b": 0.4, "c": 0.2}
    model = spark.createDataFrame([(d, t, v) for d, m in docs.items() for t, v in m.items()], "doc_id bigint, term string, value double")
    background = spark.createDataFrame(list(pc.items()), "term string, pc double")
    logaddexp = lambda t, p: pc[t] if p == 0 else math.log(math.exp(pc[t]) + math.exp(math.log(p) + 0.1))
    want = {(q, d): -sum(v * logaddexp(t, docs[d].get(t, 0)) for t, v in docs[q].items()) for q in (1, 2, 3) for d in docs}
    got = {(r["q"], r["doc_id"]): r["ce"] for r in weighting.cross_entropy(model, model, background).collect()}
    assert got == pytest.approx(want)


def test_every_query_document_pair_is_ranked(spark, sf):
    model = catalog.dense_model(spark, sf)[0].select("doc_id").distinct()
    assert QUERIES["plm_cross_entropy"](spark, sf).count() == model.count() * catalog.asked(model).count()


def test_impostors_meet_all_pairs():
    assert (catalog.BOOT.iterations, catalog.BOOT.n_features, catalog.PAIRS) == (10, 1000, 500)
