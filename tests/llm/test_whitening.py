import math
from fractions import Fraction

import numpy as np
import pytest

from paceline.llm import whitening as W


def table(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def reference(rows, scale=64, shift=1_000_000):
    """Ids, integers and exact deviations of the usable rows, from the definition."""
    good = [(i, [math.floor(scale * x) + shift for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, v + [shift] * (width - len(v))) for i, v in good]
    n, total = len(good), [sum(c) for c in zip(*(v for _, v in good), strict=True)]
    return good, n, total, [sum((n * x - s) ** 2 for x, s in zip(v, total, strict=True)) for _, v in good]


def eigen(good, total):
    x = np.array([[float(Fraction(a * len(good) - s, len(good))) for a, s in zip(v, total, strict=True)] for _, v in good])
    values, axes = np.linalg.eigh(x.T @ x / len(good))
    return x, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("k, dim, wider", [(32, 24, 2), (5, 40, 2), (3, 60, 1)])
def test_against_numpy(spark, k, dim, wider):
    rng = np.random.default_rng(dim)
    mix = np.linalg.qr(rng.standard_normal((dim, dim)))[0] * np.geomspace(4, 0.2, dim)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((400, dim)) @ mix.T)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [math.nan] * dim), (902, [math.inf] * dim), (903, [1.0, None]), (904, [1.5, -0.5]), (905, [])]
    df = table(spark, rows)
    model = W.fit(df, settings=W.Settings(k=k, wider=wider))
    good, n, total, far = reference(rows)
    x, values, axes = eigen(good, total)
    kept = min(k, dim)
    assert (model.n, list(model.total), len(model.values)) == (n, total, kept)
    assert np.allclose(model.values, values[:kept], rtol=1e-10) and math.isclose(model.trace, values.sum(), rel_tol=1e-10)
    assert np.abs(np.abs((model.axes * axes[:, :kept]).sum(0)) - 1).max() < 1e-12
    assert (model.residuals <= 1e-12 * values[0]).all() and (model.passes == 1 or k * wider < dim)
    assert W.identity_error(df, model) < 1e-8
    signs = np.sign((model.axes * axes[:, :kept]).sum(0))
    want = x @ axes[:, :kept] * signs / np.sqrt(values[:kept])
    got = sorted(W.transform(df, model).collect(), key=lambda r: str((r.vec_id, r.embedding)))
    order = sorted(range(n), key=lambda j: str((good[j][0], next(v for i, v in rows if i == good[j][0]))))
    assert [int(r.deviation) for r in got] == [far[j] for j in order]
    assert np.abs(np.array([r.whitened for r in got]) - want[order]).max() < 1e-6


def test_a_slow_spectrum_makes_the_block_wider(spark):
    rng = np.random.default_rng(3)
    df = table(spark, [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((300, 50)))])
    model = W.fit(df, settings=W.Settings(k=4, wider=1, patience=5))
    good, _, total, _ = reference([(r.vec_id, r.embedding) for r in df.collect()])
    assert np.allclose(model.values, eigen(good, total)[1][:4], rtol=1e-10) and model.passes < 40


def test_huge_entries_are_exact(spark):
    rows = [(1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [1e12, 0.25]), (4, [0.1, 0.1])]
    model = W.fit(table(spark, rows))
    got = {r.vec_id: r.deviation for r in W.transform(table(spark, rows), model).collect()}
    cut = [(i, [max(-W.LIMIT, min(W.LIMIT, 64 * x)) / 64 for x in v]) for i, v in rows]
    want = reference(cut)
    assert list(model.total) == want[2] and {i: int(got[i]) if got[i] is not None else None for i in got} == {i: d if d < 10**38 else None for (i, _), d in zip(want[0], want[3], strict=True)}
    near = [(1, [1e9, 2.0]), (2, [-1e9, 3.0]), (3, [1e7, 0.25])]
    model = W.fit(table(spark, near))
    assert [int(r.deviation) for r in W.transform(table(spark, near), model).orderBy("vec_id").collect()] == reference(near)[3]


def test_no_variance_no_rows_and_clashing_names(spark):
    same = table(spark, [(1, [1.0, 2.0])] * 3)
    model = W.fit(same)
    assert len(model.values) == 0 and W.identity_error(same, model) == 0.0
    assert [(r.whitened, int(r.deviation)) for r in W.transform(same, model).collect()] == [([], 0)] * 3
    for rows in ([], [(1, None)], [(1, [])]):
        assert len(W.fit(table(spark, rows)).values) == 0
    flat = table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    assert len(W.fit(flat).values) == 1  # one direction holds all variance
    odd = spark.createDataFrame([(1, [1.0], 5, "x"), (2, [3.0], 6, "y")], "vec_id long, Embedding array<float>, made int, whitened string")
    out = W.transform(odd, W.fit(odd, "Embedding"), "Embedding")
    assert out.columns == ["vec_id", "Embedding", "made", "whitened", "deviation"]
    assert sorted((r.vec_id, r.made, round(abs(r.whitened[0]), 6), int(r.deviation)) for r in out.collect()) == [(1, 5, 1.0, 16384), (2, 6, 1.0, 16384)]
