import numpy as np
import pytest

from calamus.llm import vectors

SCHEMA = "vec_id bigint, vec array<float>, _id string, cell string, neighbour bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash", 0) for i, v in rows], SCHEMA)


def brute(x, k, floor=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if floor is None or s[i, j] >= floor}


def data(n, seed=3, groups=40, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 64))
    noise = rng.standard_normal((n // 2, 64))
    close = centres[rng.integers(0, groups, n - n // 2)] + spread * rng.standard_normal((n - n // 2, 64))
    return (np.vstack([noise, close]) * rng.uniform(0.2, 5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("block", [8192, 50])
def test_recall_with_floor(spark, block):
    x = data(3000)
    got = {(r["vec_id"], r["neighbour"]) for r in vectors.nearest(frame(spark, enumerate(x)), 5, 0.9, per_cell=100, block_rows=block).collect()}
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want) + 2


def test_recall_without_floor(spark):
    x = data(3000)
    got = {(r["vec_id"], r["neighbour"]) for r in vectors.nearest(frame(spark, enumerate(x)), 5, per_cell=400).collect()}
    assert len(got) == 15000
    assert len(got & brute(x, 5)) >= 0.9 * 15000


def test_recall_without_floor_over_many_cells(spark):
    x = data(3000)
    got = {(r["vec_id"], r["neighbour"]) for r in vectors.nearest(frame(spark, enumerate(x)), 5, per_cell=100).collect()}
    assert len(got) == 15000
    assert len(got & brute(x, 5)) >= 0.995 * 15000


@pytest.mark.parametrize("block", [200, 5000])
def test_blocks_of_queries_do_not_change_what_is_found(spark, block):
    x = data(1500, groups=10, spread=0.1)
    got = {(r["vec_id"], r["neighbour"]) for r in vectors.nearest(frame(spark, enumerate(x)), 5, per_cell=60, block_rows=block).collect()}
    assert len(got) == 7500 and len(got & brute(x, 5)) >= 0.99 * 7500


def test_probes_are_few_where_cells_are_apart():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64)).astype(np.float32)
    x = np.repeat(centres, 100, 0) + 0.05 * rng.standard_normal((3000, 64)).astype(np.float32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    probes = vectors.probed_cells(vectors.fit(x, 30), x, 5, 0.99)
    assert probes.shape[0] == 30 and probes.shape[1] <= 10 and (probes[:, 0] == np.arange(30)).all()


def test_unusable_repeated_and_copies(spark):
    x = data(12, groups=2)
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[0]), (20, None), (21, [0.0] * 64), (22, [1.0] * 63), (23, [float("nan")] * 64), (24, [None] * 64), (None, x[1])]
    rows += [(100 + i, x[3]) for i in range(9)]
    found = vectors.nearest(frame(spark, rows), 5)
    got = {}
    for r in found.collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour"], r["similarity"])
    assert set(got) == {*range(12), *range(100, 109)}
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    assert [got[108][k][0] for k in range(1, 6)] == [3, 100, 101, 102, 103] and got[108][1][1] == 1
    assert [got[3][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]


def test_small_groups_of_copies_look_further(spark):
    x = data(40, groups=3)
    rows = [(i, v) for i, v in enumerate(x)] + [(200, x[30])]
    allx, ids = np.vstack([x, x[30:31]]), [*range(40), 200]
    want = {(ids[i], ids[j]) for i, j in brute(allx, 5, 0.7)}
    got = {(r["vec_id"], r["neighbour"]) for r in vectors.nearest(frame(spark, rows), 5, 0.7).collect()}
    assert len(got ^ want) <= 0.05 * len(want)


def test_few_and_none(spark):
    assert vectors.nearest(frame(spark, []), 5).count() == 0
    assert vectors.nearest(frame(spark, []), 5, 0.9).count() == 0
    assert vectors.nearest(frame(spark, [(1, data(1)[0])]), 5).count() == 0
    pairs = vectors.close_pairs(frame(spark, [(1, [1.0] * 64), (2, [2.0] * 64), (3, [-1.0] * 64)])).collect()
    assert [tuple(r) for r in pairs] == [(1, 2)]
