"""Whitening against exact fractions and a dense solver; eigenvectors of matrices with clusters."""

from fractions import Fraction

import numpy as np
import pytest

from asofkit.llm import whitening as wh

RNG = np.random.default_rng(3)


def turned(values, seed=0):
    """A symmetric matrix with given eigenvalues, and its eigenvectors, in extended precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(wh.EXTENDED)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values), dtype=wh.EXTENDED) - 0.5 * (q.T @ q))
    v = (q * np.array(values, dtype=wh.EXTENDED)) @ q.T
    return (v + v.T) / 2, q


@pytest.mark.parametrize(
    "values", [list(range(12, 0, -1)), [5, 5, 5, 1, 1, 0], [1 + 1e-9 * k for k in range(8, 0, -1)], [10, 3 + 2e-12, 3 + 1e-12, 3, 1e-6, 0], [1e12, 1.0, 1e-3], [7.0] * 5, [2.5], [1, 1 - 1e-7, 1 - 2e-7, 0.5, 0.5 - 1e-10]]
)
def test_eigenvectors_to_double_precision(values):
    values = sorted(values, reverse=True)
    v, q = turned(values)
    e, x = wh.eigenvectors(v)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(v @ x - x * e).max() < 1e-17 * len(values) * max(values) * 8
    assert np.allclose(e.astype(float), values, rtol=0, atol=1e-15 * max(values))
    gaps = [min([abs(a - b) for k, b in enumerate(values) if k != i], default=1) for i, a in enumerate(values)]
    for i, gap in enumerate(gaps):
        if gap > 1e-11 * max(values):
            assert min(np.abs(x[:, i] - q[:, i]).max(), np.abs(x[:, i] + q[:, i]).max()) < 1e-17 * max(values) / gap + 1e-16


def rows_of(n=300, d=20):
    base = RNG.normal(size=(n, d)) @ RNG.normal(size=(d, d)) * 0.2 + RNG.normal(size=d)
    return [[float(np.float32(c)) for c in r] for r in base]


def test_whitening_equals_fractions_and_a_dense_solver(spark):
    vectors = rows_of()
    rows = [(k, v, 1) for k, v in enumerate(vectors)] + [(k, vectors[0], 1) for k in range(300, 420)] + [(None, vectors[1], 2), (3, vectors[3], 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * 20, 1), (903, [None] + [1.0] * 19, 1), (904, [1.0] * 19, 1), (905, [float("-inf")] + [0.0] * 19, 1)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int").repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    assert len(found) == 16 * len(kept)
    longs = lambda v: tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)
    fit = sorted({longs(v) for _, v, _ in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(x) - Fraction(s, n)) for x, s in zip(r, sums)] for r in fit])
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {}
    for vid, v, _ in kept:
        x = longs(v)
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)]) @ q / np.sqrt(e)
        for c in range(16):
            for r in by[(vid, c + 1)]:
                if len(by[(vid, c + 1)]) == 1:
                    sign.setdefault(c, np.sign(r["whitened"] * want[c]))
                    assert abs(r["whitened"] - sign[c] * want[c]) < 1e-9
                    assert r["deviation"] == deviation
                assert r["n"] == n and abs(r["explained"] / (e[c] / np.trace(cov)) - 1) < 1e-9
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-10


def test_few_and_flat_and_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert wh.whiten(make([])).collect() == [] and wh.whiten(make([("a", None)])).collect() == []
    one = wh.whiten(make([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    flat = wh.whiten(make([("a", [0.0, 1.0]), ("b", [1.0, 2.0]), ("c", [3.0, 4.0])])).collect()  # all on one line
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-12
    huge = {(r["vec_id"], r["component"]): r for r in wh.whiten(make([("a", [1e300, 0.0]), ("b", [0.0, 1.0]), ("c", [-5e8, 2.0])])).collect()}
    assert len(huge) == 6 and huge[("a", 1)]["deviation"] is None and huge[("b", 1)]["identity_error"] < 1e-4


def test_sums_over_many_tasks_are_exact(spark):
    rows = [(k, [float(v[0]), float(v[1])]) for k, v in enumerate(RNG.integers(-50, 50, size=(2000, 2)))]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    models = [wh.fit_whitening(df.repartition(p)) for p in (1, 70)]
    assert models[0].sums == models[1].sums and np.array_equal(models[0].vectors, models[1].vectors) and np.array_equal(models[0].values, models[1].values)
