"""Whitening against exact fractions; limbs, ill-conditioned data, copies, nulls, ranks."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tagweave.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, x int, whitened string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "own") for i, v in vectors], SCHEMA)


def applied(spark, vectors, components=16):
    rows = w.integers(table(spark, vectors), "embedding", "vec_id")
    model = w.fit(rows, components)
    return model, w.whiten(rows, model).collect()


def exact(vectors):
    ints = [tuple(int(np.floor(64 * e)) + 1000000 for e in v) for v in vectors]
    fit = sorted(set(ints))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return ints, fit, n, s, v


def test_limbs_and_products_are_exact():
    rng = random.Random(1)
    x = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(5)] for _ in range(300)], np.int64)
    for scale in (0, 20, 47, 61):
        y = x >> scale
        assert (sum(limb.astype(object).astype(int) * (1 << (w.LIMB * k)) for k, limb in enumerate(w.limbs(y))) == y).all()
        wide = np.concatenate([np.ones((300, 1), object), y.astype(object)], axis=1)
        got = sum(g.astype(object) * (1 << (w.LIMB * s)) for s, g in w.products(y).items())
        assert (got == wide.T @ wide).all()


def test_against_fractions_with_copies_nulls_and_repeated_rows(spark):
    rng = random.Random(2)
    mix = [[rng.gauss(0, 1) * (k + 1) for _ in range(6)] for k in range(6)]
    base = [[sum(rng.gauss(0, 1) * m[j] for m in mix) for j in range(6)] for _ in range(80)]
    good = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[3]) for i in range(60)] + [(5, base[5]), (None, base[6])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [1.0] * 5 + [float("inf")]), (204, []), (205, [1.0] * 4)]
    model, got = applied(spark, good + bad)
    ints, fit, n, s, v = exact([x for _, x in good])
    assert (model.n, model.sums) == (n, s) and len(got) == len(good)
    want = {tuple(x): sum((n * e - t) ** 2 for e, t in zip(x, s)) for x in ints}
    by_id = {i: x for (i, _), x in zip(good, ints)}
    assert all(r["deviation"] == want[by_id[r["vec_id"]]] for r in got)
    values = np.linalg.eigvalsh(np.array(v, float))[::-1]
    assert np.allclose(model.values, values, rtol=1e-9) and np.allclose(model.explained, values / values.sum(), rtol=1e-9)
    z = np.array([(np.array(x, float) - np.array([float(Fraction(t, n)) for t in s])) @ model.axes / np.sqrt(model.values) for x in fit])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(6)).max() < 1e-6 and model.identity_error < 1e-9
    at = {x: k for k, x in enumerate(fit)}
    assert all(np.allclose(r["whitened"], z[at[by_id[r["vec_id"]]]], atol=1e-9) for r in got)


def test_eigenvalues_far_apart_keep_their_precision(spark):
    """Scales from 1 to a million, mixed: the smallest of ten eigenvalues is 1e-12 of the largest."""
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) * 4**k + (rng.gauss(0, 1) * 4 ** (k - 1) if k else 0) for k in range(11)]) for i in range(400)]
    model, _ = applied(spark, vectors)
    _, _, n, _, v = exact([x for _, x in vectors])
    assert len(model.values) == 11 and model.identity_error < 1e-8
    for e, axis in zip(model.values, model.axes.T):
        a = [Fraction(float(x)) for x in axis]
        spread = sum(a[i] * v[i][j] * a[j] for i in range(11) for j in range(11))
        assert abs(float(spread) / e - 1) < 1e-9
    assert list(model.values) == sorted(model.values, reverse=True)


def test_large_entries_use_whole_numbers(spark):
    vectors = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1e12, 3), (-1e12, 5), (4e11, -7), (1e300, 0), (0, 0)])]
    model, got = applied(spark, vectors)
    assert model.n == 5 and len(got) == 5 and all(r["deviation"] is None for r in got)
    model, got = applied(spark, vectors[:3])
    ints, _, n, s, _ = exact([x for _, x in vectors[:3]])
    want = [sum((n * e - t) ** 2 for e, t in zip(x, s)) for x in ints]
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["vec_id"])] == [x if x < 1 << 63 else None for x in want]


@pytest.mark.parametrize("vectors,rank", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])] * 4, 0), ([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], 1), ([(i, [float(i == k) for k in range(4)]) for i in range(3)], 2)])
def test_ranks(spark, vectors, rank):
    model, got = applied(spark, vectors)
    assert len(model.values) == rank and len(got) == sum(v is not None for _, v in vectors)
    assert all(len(r["whitened"]) == rank for r in got)


def test_at_most_the_components_asked_for(spark):
    rng = random.Random(4)
    model, got = applied(spark, [(i, [rng.random() for _ in range(20)]) for i in range(60)], 7)
    assert len(model.values) == 7 and all(len(r["whitened"]) == 7 for r in got) and sum(model.explained) < 1
