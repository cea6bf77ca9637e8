import math
from collections import Counter

import pytest

from calamus.llm import distinctive, frequencies, queries, sql
from tests.compare import assert_same
from tests.test_text import reference_terms

SCHEMA = "doc_id bigint, author string, title string, tokens array<string>, lang string, loaded_at string, term string, tf bigint, _id string, n_records int"
ROWS = [
    (1, ["Aap", "aap ", "a1p", None, ""], "x"), (1, ["Aap", "aap ", "a1p", None, ""], "later"), (2, ["áap", "noot"], "x"), (3, ["a\u0301ap", "mies!"], "x"),
    (4, None, "x"), (5, [], "x"), (6, [None, "123", "  "], "x"), (None, ["aap"], "x"), (7, ["noot"] * 6 + ["wim", "zus", "jet"], "x"),
]


def corpus(spark, rows=ROWS):
    return spark.createDataFrame([(i, None, None, t, None, at, "clash", 3, "clash", 9) for i, t, at in rows], SCHEMA)


def brute(rows=ROWS):
    recs = {i: reference_terms(" ".join(x for x in t if x is not None)) for i, t, _ in rows if t is not None and i is not None}
    return recs


def test_log_entropy_against_brute_force(spark):
    recs = brute()
    cf, n = Counter(x for r in recs.values() for x in r), len(recs)
    df = Counter(x for r in recs.values() for x in set(r))
    got = {(r["doc_id"], r["term"]): r for r in distinctive.log_entropy(corpus(spark)).collect()}
    assert set(got) == {(i, t) for i, r in recs.items() for t in r}
    for (i, t), r in got.items():
        tf = recs[i].count(t)
        entropy = -sum(x.count(t) / cf[t] * math.log(x.count(t) / cf[t]) for x in recs.values() if t in x)
        assert (r["tf"], r["cf"], r["df"], r["length"], r["n_records"], r["n_terms"]) == (tf, cf[t], df[t], len(recs[i]), n, sum(cf.values()))
        assert r["score"] == pytest.approx(math.log1p(tf) * (1 - entropy / math.log(n)), abs=1e-9)


def test_heavy_terms_do_not_change_scores(spark):
    a = {(r["doc_id"], r["term"]): r["score"] for r in distinctive.log_entropy(corpus(spark), heavy_share=0.0).collect()}
    b = {(r["doc_id"], r["term"]): r["score"] for r in distinctive.log_entropy(corpus(spark), heavy_share=1.0).collect()}
    assert a == b


def test_one_record_and_none(spark):
    assert {r["score"] for r in distinctive.log_entropy(corpus(spark, [(1, ["a", "b"], "x")])).collect()} == {0.0}
    empty = corpus(spark, [])
    assert distinctive.log_entropy(empty).count() == 0 and distinctive.marking_terms(empty).count() == 0
    assert frequencies.term_frequencies(empty).count() == 0


def test_marking_terms(spark):
    rows = [(i, [f"w{chr(97 + i % 20)}{chr(97 + i // 20)}", "en"] * 10, "x") for i in range(100)]
    rows += [(100, ["merk"] * 5 + ["en"] * 5, "x"), (101, ["merk"] + ["en"], "x")]
    assert [(r["doc_id"], r["term"]) for r in distinctive.marking_terms(corpus(spark, rows)).collect()] == [(100, "merk")]


@pytest.mark.parametrize(("bits", "leaf"), [(4, 4_000_000), (1, 2), (2, 1)])
def test_radix_counts_against_brute_force(spark, bits, leaf):
    recs = brute()
    want = {(t, sum(r.count(t) for r in recs.values()), sum(t in r for r in recs.values())) for r in recs.values() for t in r}
    got = frequencies.term_frequencies(corpus(spark), bits=bits, leaf_rows=leaf, max_bits=8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_record_and_hot_term(spark):
    rows = [(1, ["heet"] * 50_000 + [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}" for i in range(100)], "x")] + [(i, ["heet"], "x") for i in range(2, 40)]
    got = {r["term"]: r for r in frequencies.marked_terms(corpus(spark, rows), bits=2, leaf_rows=5, max_bits=6).collect()}
    assert (got["heet"]["occurrences"], got["heet"]["records"], got["heet"]["mark"]) == (50_038, 39, "common")
    assert got["waa"]["mark"] == "rare"


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_against_sql(name, spark, sf, duck):
    assert_same(queries.queries()[name](spark, sf), duck, sql.ORACLE[name])
