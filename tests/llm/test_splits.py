import random

from calamus.llm import splits

SCHEMA = "doc_id bigint, author string, title string, component string, split string, n int, a string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, a, t, "clash", "clash", 1, "clash") for i, a, t in rows], SCHEMA)


def union_find(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, a, t in rows:
        a = a.strip().upper() if a else None
        if a:
            find(("a", a))
            if t and "_" in t:
                up[find(("a", a))] = find(("s", t.split("_")[0].lower()))
    groups = {}
    for x in list(up):
        if x[0] == "a":
            groups.setdefault(find(x), set()).add(x[1])
    return {frozenset(g) for g in groups.values()}


def found(components):
    groups = {}
    for r in components.collect():
        groups.setdefault(r["component"], set()).add(r["author"])
    assert all(min(g) == c for c, g in groups.items())
    return {frozenset(g) for g in groups.values()}


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    rows = [(i, f"{'abcdef'[rnd.randrange(6)]}{rnd.randrange(40)}{' ' * rnd.randrange(2)}", rnd.choice(["plain", f"S{rnd.randrange(60)}_x", f"s{rnd.randrange(60)}_y", None])) for i in range(150)]
    rows += [(1000, None, "s1_x"), (1001, "  ", "s2_x"), (1002, "NEW", "_"), (1003, "NEWER", "_b")]
    assert found(splits.author_components(corpus(spark, rows))) == union_find(rows)


def test_long_chain_and_star(spark):
    rows = [(2 * i, f"c{i:03}", f"k{i}_1") for i in range(60)] + [(2 * i + 1, f"c{i:03}", f"k{i + 1}_2") for i in range(60)]
    rows += [(500 + i, f"z{i:03}", "hub_1") for i in range(50)]
    assert found(splits.author_components(corpus(spark, rows))) == union_find(rows)
    pairs = splits.tied_authors(splits.author_components(corpus(spark, rows)))
    assert pairs.count() == 60 * 59 // 2 + 50 * 49 // 2 and pairs.where("author_1 >= author_2").count() == 0


def test_shares_and_labels(spark):
    rows = [(i, f"a{i % 400}", f"t{i}") for i in range(3000)] + [(5000, None, "x_1"), (5000, None, "x_1"), (5001, None, None)]
    labels, state = splits.split_records(corpus(spark, rows))
    got = {r["doc_id"]: r for r in labels.collect()}
    assert len(got) == 3002 == labels.count()
    by = {}
    for r in got.values():
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(x) == 1 for x in by.values())
    share = {s: sum(r["split"] == s for r in got.values()) / 3002 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    assert state.members.where("kind <> 'stem'").count() == 402 and state.records.count() == 3002


def test_hot_component_and_increment(spark):
    rows = [(i, "hot", None) for i in range(300)] + [(1000 + i, f"b{i}", f"s{i}_1") for i in range(600)]
    labels, state = splits.split_records(corpus(spark, rows))
    first = {r["doc_id"]: r["split"] for r in labels.collect()}
    assert first[0] == "train"
    by = {r["member"]: r["split"] for r in state.members.where("kind = 'author'").collect()}
    train = next(a for a, s in by.items() if s == "train" and a != "HOT")
    other = next(a for a, s in by.items() if s == "test")
    new = rows + [(9000, "fresh", f"s{train[1:]}_2"), (9001, train, "bridge_1"), (9002, other, "bridge_2"), (9003, "own", "q")]
    labels, _ = splits.split_records(corpus(spark, new), previous=state)
    got = {r["doc_id"]: r["split"] for r in labels.collect()}
    assert got[9001] == got[9002] == got[9000] == "quarantine"
    assert got[9003] in ("train", "validation", "test")
    assert all(got[i] == s for i, s in first.items() if got[i] != "quarantine")


def test_empty(spark):
    labels, state = splits.split_records(corpus(spark, []))
    assert labels.count() == 0 and state.members.count() == 0


def test_state_lasts_over_runs_of_new_records_only(spark, tmp_path):
    rows = [(i, f"a{i % 150}", f"t{i % 150}_{i}") for i in range(200)] + [(12, "#12", "q"), (300, None, "x"), (301, "RECORD:300", "y")]
    labels, state = splits.split_records(corpus(spark, rows))
    first = {r["doc_id"]: (r["component"], r["split"]) for r in labels.collect()}
    assert first[300][0] != first[301][0]
    new = [(1000, "newcomer", "T7_later"), (1001, "a9", "z"), (1002, "b", "own_1"), (1003, "c", "OWN_2"), (5, "a5", "t5_5"), (1004, "bridge", "t1_n"), (1005, "bridge", "t2_n"), (1006, None, "t1_n")]
    state.save(f"file://{tmp_path}/run1")
    labels, later = splits.split_records(corpus(spark, new), splits.State.load(spark, f"file://{tmp_path}/run1"))
    got = {r["doc_id"]: r["split"] for r in labels.collect()}
    assert set(got) == {x[0] for x in new} and got[5] == first[5][1] and got[1000] == first[7][1] and got[1001] == first[9][1] and got[1002] == got[1003]
    both = {first[1][1], first[2][1]}
    assert got[1004] == got[1005] == (both.pop() if len(both) == 1 else "quarantine")
    assert later.records.count() == state.records.count() + len(new) - 1
    before, after = ({(r["kind"], r["member"]): r for r in s.members.collect()} for s in (state, later))
    assert set(before) < set(after) and all(after[k]["split"] == r["split"] for k, r in before.items())
    assert after["author", "A9"]["n"] == before["author", "A9"]["n"] + 1 and after["author", "A5"]["n"] == before["author", "A5"]["n"]
    labels, last = splits.split_records(corpus(spark, [(2000, "newest", "t7_last")]), later)
    assert [r["split"] for r in labels.collect()] == [first[7][1]] and last.members.count() == later.members.count() + 1


def test_increments_fill_what_is_lacking(spark):
    _, state = splits.split_records(corpus(spark, [(i, "one", None) for i in range(100)]))
    labels, _ = splits.split_records(corpus(spark, [(1000 + i, f"n{i}", None) for i in range(900)]), state)
    share = {s: sum(r["split"] == s for r in labels.collect()) / 900 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 700 / 900) < 0.03 and abs(share["test"] - 100 / 900) < 0.03
