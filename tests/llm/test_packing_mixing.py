import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calamus.llm import mixing, packing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, len string, _n int, container string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, "clash", 1, "clash") for i, t, s in rows], DOCS)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=40))
def test_plan_uses_every_item_once(counts):
    plan = packing.plan_patterns(counts, 100)
    used = Counter()
    for items, times in plan:
        assert sum(items) <= 100 and times > 0
        for x in items:
            used[x] += times
    assert used == Counter(counts)


def test_plan_finds_exact_complements():
    assert packing.plan_patterns({60: 5, 40: 5}, 100) == [((60, 40), 5)]
    assert sum(t for _, t in packing.plan_patterns({50: 2, 30: 2, 20: 2}, 100)) == 2
    assert sum(t for _, t in packing.plan_patterns({40: 1, 30: 1, 20: 1, 10: 1}, 100)) == 1


def test_plan_is_tight():
    rnd = random.Random(2)
    counts = Counter(min(1024, max(1, int(rnd.lognormvariate(5, 0.8)))) for _ in range(20_000))
    bins = sum(t for _, t in packing.plan_patterns(counts, 1024))
    assert bins <= 1.002 * -(-sum(k * n for k, n in counts.items()) // 1024) + 1


def test_containers(spark):
    rnd = random.Random(5)
    sizes = [rnd.randrange(1, 40) for _ in range(300)] + [7] * 150 + [64, 65, 200, 128]
    rows = [(i, "w " * n, "s") for i, n in enumerate(sizes)] + [(9000, None, "s"), (9001, " ... ", None), (9002, "", "s")]
    got = packing.pack(docs(spark, rows), 64).collect()
    load, pieces = Counter(), Counter()
    for r in got:
        load[r["container"]] += r["n_tokens"]
        pieces[r["doc_id"]] += r["n_tokens"]
    assert max(load.values()) <= 64 and pieces == Counter(dict(enumerate(sizes)))
    assert len(got) == len({(r["doc_id"], r["piece"]) for r in got}) and set(load) == set(range(len(load)))
    assert len(load) <= 1.02 * -(-sum(sizes) // 64) + 1
    n = {r["doc_id"]: r["n_pieces"] for r in packing.divided(packing.pack(docs(spark, rows), 64)).collect()}
    assert n == {i: -(-s // 64) for i, s in enumerate(sizes) if s > 64}


def test_no_documents(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.fill_report(packing.pack(docs(spark, []))).first()["containers"] == 0


TARGETS = "mix_name string, source string, target_share double, max_copies int, total string"


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def mixed(spark, rows, goals):
    taken, report = mixing.schedule(docs(spark, rows), targets(spark, goals))
    return taken.collect(), {(r["mix_name"], r["source"]): r for r in report.collect()}


def test_shares_are_reached(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(5, 30), rnd.choice(["big", "big", "big", " Big ", "mid", "small"])) for i in range(2000)] + [(5000, "w w", None), (5001, None, "mid")]
    taken, report = mixed(spark, rows, [("m", "big", 0.3, 2), ("m", "Mid", 0.3, 3), ("m", "small", 0.4, 4)])
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = sum(n for i, n in size.items() if i != 5000)
    assert all(abs(r["share"] - r["target_share"]) < 0.01 and not r["short"] for r in report.values())
    assert sum(r["tokens"] for r in report.values()) <= total < sum(r["tokens"] for r in report.values()) + 100
    for (_, s), r in report.items():
        copies = [x for x in taken if x["source"] == s]
        assert max(x["copies"] for x in copies) <= r["max_copies"]
        assert max(x["copies"] for x in copies) - min([x["copies"] for x in copies]) <= 1
        assert sum(size[x["doc_id"]] * x["copies"] for x in copies) == r["tokens"]


def test_short_and_missing_sources(spark):
    rows = [(i, "w w w w", "a") for i in range(90)] + [(100 + i, "w w w w", "b") for i in range(10)]
    taken, report = mixed(spark, rows, [("m", "a", 0.5, 3), ("m", "b", 0.4, 2), ("m", "none", 0.1, 9), ("m", "b ", 0.4, 2), ("n", "a", 1.0, 1)])
    assert report["m", "b"]["short"] and report["m", "none"]["short"] and not report["m", "a"]["short"] and report["n", "a"]["short"]
    assert report["m", "b"]["tokens"] == 80 and report["m", "none"]["size"] == 0 and report["n", "a"]["tokens"] == 360
    assert {x["copies"] for x in taken if x["source"] == "b"} == {2}


def test_a_budget_at_which_all_targets_hold(spark):
    rows = [(i, "w w w w", "a") for i in range(90)] + [(100 + i, "w w w w", "b") for i in range(10)]
    goals = targets(spark, [("m", "a", 0.6, 3), ("m", "b", 0.4, 2)])
    whole = {r["source"]: r for r in mixing.schedule(docs(spark, rows), goals)[1].collect()}
    assert whole["b"]["reachable"] == 200 and whole["b"]["share"] < 0.3 and whole["b"]["short"]
    held = {r["source"]: r for r in mixing.schedule(docs(spark, rows), goals, budget=200, per_task=3)[1].collect()}
    assert abs(held["b"]["share"] - 0.4) < 0.03 and not held["b"]["short"] and sum(r["tokens"] for r in held.values()) <= 200


@pytest.mark.parametrize(("rows", "goals"), [([], [("m", "a", 1.0, 1)]), ([(1, "w", "a")], []), ([(1, None, "a")], [("m", "a", 1.0, 1), (None, "a", 1.0, 1), ("m", None, 0.5, 1)])])
def test_little_or_nothing(spark, rows, goals):
    taken, report = mixed(spark, rows, goals)
    assert all(not r["short"] or r["size"] == 0 for r in report.values()) and len(taken) <= 1
