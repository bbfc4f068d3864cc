import math
import random

import numpy as np

from paceline.llm import knn


def brute(rows, queries, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if queries(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, queries, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = knn.whole_numbers(df).cache()
    got = knn.top_k(data, data.where(queries), knn.Settings(**settings))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def test_exact_with_ties_and_bad_rows(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one very common vector
    rows += [(2001, None), (None, rows[0][1]), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [0.0] * 6), (2006, []), (2010, [1.0, 2.0])]
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, "id % 10 = 0") == want
    assert run(spark, rows, "id % 10 = 0", bucket=4, block=3) == want


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], "id = 0") == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])], "id = 0") == []
    assert run(spark, [], "id = 0") == []


def test_large_values_stay_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 3.0])]
    assert run(spark, rows, "id = 0") == brute(rows, lambda i: i == 0)


def test_groups_get_only_the_cells_they_need(spark):
    rng = random.Random(5)
    centres = [[rng.choice((-9.0, 9.0)) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 12]]) for i in range(1200)]
    assert run(spark, rows, "id % 7 = 0", bucket=16, block=10) == brute(rows, lambda i: i % 7 == 0)


def test_bounds_of_groups_hold_for_their_queries():
    rng = np.random.default_rng(2)
    centres = rng.choice([-2000.0, 2000.0], (12, 8))
    data = np.concatenate([c + rng.normal(0, 40, (50, 8)) for c in centres])
    cell = np.repeat(np.arange(12), 50)
    far = np.sqrt(((data - centres[cell]) ** 2).sum(axis=1))
    radius = np.array([far[cell == c].max() for c in range(12)])
    nearest = np.array([np.sort(far[cell == c])[:6] for c in range(12)])
    true = [set(cell[np.argsort(-(data @ q))[:5]].tolist()) for q in data]
    sent = 0
    for g in range(12):
        mid = centres[g][None, :] @ centres.T
        off = radius[g] * np.sqrt((centres**2).sum(axis=1))[None, :]
        open_ = knn.needed(mid, (mid - off, mid + off, np.array([[np.sqrt((data[cell == g] ** 2).sum(axis=1)).max()]])), nearest, radius, 5)[0]
        sent += int(open_.sum())
        assert all(open_[c] for i in np.flatnonzero(cell == g) for c in true[i])
    assert sent < 12 * 12 / 2


def test_blocks_cut_large_groups_and_join_small_ones():
    assert knn.blocks_of([2, 0, 1, 3], {0: 3, 1: 25, 2: 4, 3: 9}, 10) == {2: (0, 1), 0: (0, 1), 1: (1, 3), 3: (4, 1)}
    assert sorted(knn.chain(np.array([[0.0], [5.0], [1.0], [6.0]]))) == [0, 1, 2, 3]
    assert knn.chain(np.array([[0.0], [5.0], [1.0], [6.0]])) == [0, 2, 1, 3]


def test_other_columns_don_t_matter(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0, i) for i, v in rows], "vec_id long, embedding array<double>, ID int, v string, bucket double, query_id long")
    data = knn.whole_numbers(df).cache()
    got = knn.top_k(data, data.where("id % 10 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)
