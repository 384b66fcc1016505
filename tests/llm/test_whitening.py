"""Whitening against exact fractions and the definition of an eigenvector; sums in two parts against exact ones."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rhythmspan.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x int, component string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, v, 0, "a", 1, "b") for i, v in enumerate(vectors)], SCHEMA)


def exact(vectors):
    """(n, sums, covariance) of distinct vectors in whole numbers, as fractions."""
    x = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    n, dims = len(x), len(x[0])
    mean = [Fraction(sum(v[d] for v in x), n) for d in range(dims)]
    return x, [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n for j in range(dims)] for i in range(dims)]


def test_rows_against_fractions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, [30, 8, 2, 1, 0.5], (80, 5)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, math.nan, 2.0, 3.0, 4.0], [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0, 0.0, 0.0]]
    vectors = [*base, *bad, base[0], base[0], base[1]]
    ids = [*range(80), *range(80, 87), 0, None, 90]
    got = whitening.whiten(table(spark, vectors, ids).repartition(7), 4).collect()
    x, cov = exact(base)
    n, sums = len(x), [sum(v[d] for v in x) for d in range(5)]
    assert len(got) == 83 * 4 and {r.n for r in got} == {n}
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [*range(80), 90] and sum(r.vec_id is None for r in got) == 4
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert {r.component for r in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-12
    white = np.zeros((80, 4))
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-12)
        if r.vec_id is not None and 0 < r.vec_id < 80:
            own = [math.floor(64 * c) + 1_000_000 for c in base[r.vec_id]]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
            white[r.vec_id, r.component - 1] = r.whitened
    centred = np.array([[float(Fraction(math.floor(64 * c) + 1_000_000) - Fraction(s, n)) for c, s in zip(b, sums, strict=True)] for b in base])
    for k in range(4):  # whitened * sqrt(e) = C a with V a = e a
        axis = np.linalg.lstsq(centred[1:], white[1:, k] * math.sqrt(values[k]), rcond=None)[0]
        assert np.linalg.norm(axis) == pytest.approx(1, rel=1e-9)
        assert np.allclose(v @ axis, values[k] * axis, atol=1e-8 * values[0])
    copies = {r.component: r.whitened for r in got if r.vec_id is None}
    assert copies == {r.component: r.whitened for r in got if r.vec_id == 0}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_components_of_no_variance_are_left_out(spark):
    got = whitening.whiten(table(spark, [[float(i), 2.0 * i, 7.0] for i in range(9)]), 3).collect()
    assert {r.component for r in got} == {1} and len(got) == 9


def test_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(5)
    high = rng.normal(0, 1, (2500, 3)) * [1e9, 1.0, 1e-9]
    low = high * rng.uniform(-1e-17, 1e-17, high.shape)
    total = whitening.DoubleDouble.zeros(3, 3)
    whitening.outer_products(total, high, low)
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True))
            got = Fraction(total.high[i, j]) + Fraction(total.low[i, j])
            assert abs(got - want) <= Fraction(2) ** -72 * 2500 * Fraction(np.abs(high[:, i]).max()) * Fraction(np.abs(high[:, j]).max())


def test_an_offset_costs_no_digits():
    centre = whitening.Centre(3, [3_000_000_001, 7, -5])
    x = np.array([[1_000_000_003, 2, -1]])
    high, low = centre.centred(x)
    for d, s in enumerate(centre.sums):
        assert abs(Fraction(high[0, d]) + Fraction(low[0, d]) - (int(x[0, d]) - Fraction(s, 3))) < Fraction(2) ** -90
    assert centre.deviation(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(x[0], centre.sums, strict=True))]
    assert whitening.Centre(1 << 33, [0]).deviation(np.array([[1], [1 << 20]])) == [None, None]
