"""Whitening: exact numbers against fractions, components against a plain solve, odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm.queries import op12_whitening
from tracelake.llm.whitening import Fit, add_pairs, components, covariance, deviations, fit, outer_sums, two_sum, usable, whiten


def points(spark, sf_dir):
    return {r.vec_id: [math.floor(1024 * c) + 100000 for c in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}


def test_query(spark, sf_dir):
    x = points(spark, sf_dir)
    n, sums = len(x), [sum(col) for col in zip(*x.values(), strict=True)]
    rows = op12_whitening(spark, sf_dir).collect()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    white = {k: [0.0] * 8 for k in x}
    for r in rows:
        assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
        white[r.vec_id][r.component - 1] = r.whitened
    centred = np.array([[float(v - Fraction(s, n)) for v, s in zip(row, sums, strict=True)] for row in x.values()])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    w = np.array(list(white.values()))
    for k in range(8):
        assert {r.explained for r in rows if r.component == k + 1}.pop() == pytest.approx(values[-1 - k] / np.trace(cov), rel=1e-9)
        want = centred @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
        assert min(np.abs(w[:, k] - want).max(), np.abs(w[:, k] + want).max()) < 1e-8
    error = np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(8)).max()
    assert {r.identity_error for r in rows}.pop() < 1e-9 and error < 1e-9


def test_error_free_parts():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50) * 10.0 ** rng.integers(-20, 20, 50), rng.normal(size=50) * 10.0 ** rng.integers(-20, 20, 50)
    s, e = two_sum(a, b)
    assert all(Fraction(p) + Fraction(q) == Fraction(x) + Fraction(y) for p, q, x, y in zip(a.tolist(), b.tolist(), s.tolist(), e.tolist(), strict=True))
    hi, lo = add_pairs(np.array([1e16]), np.array([0.25]), np.array([-1e16]), np.array([2.0**-60]))
    assert Fraction(hi[0]) + Fraction(lo[0]) == Fraction(1, 4) + Fraction(1, 2**60)


def test_outer_sums_have_more_digits_than_a_double():
    rng = np.random.default_rng(7)
    hi = rng.normal(size=(1000, 3)) * np.array([1.0, 1e3, 1e-3])
    lo = hi * rng.normal(size=hi.shape) * 2.0**-55
    top, rest = outer_sums(hi, lo)
    exact = [[Fraction(a) + Fraction(b) for a, b in zip(r.tolist(), s.tolist(), strict=True)] for r, s in zip(hi, lo, strict=True)]
    scale = Fraction(float(np.abs(hi).max())) ** 2 * 1000
    for i in range(3):
        for j in range(3):
            want = sum(r[i] * r[j] for r in exact)
            assert abs(Fraction(top[i, j]) + Fraction(rest[i, j]) - want) < scale / 2**75


def test_covariance_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (1000 * rng.normal(size=5) * [1, 1, 1, 1e-2, 1e-3] + 3e6).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = []
    for parts in (1, 3, 140):
        some = usable(frame.repartition(parts), "vec_id", "embedding")
        fitted = fit(some)
        found.append(covariance(some, fitted))
    x = [[math.floor(1024 * c) + 100000 for c in r[1]] for r in rows]
    want = [[float(sum((Fraction(r[i]) - Fraction(fitted.sums[i], 1500)) * (r[j] - Fraction(fitted.sums[j], 1500)) for r in x) / 1500) for j in range(5)] for i in range(5)]
    assert all((c == found[0]).all() for c in found) and np.abs(found[0] / np.array(want) - 1).max() < 1e-15


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (None, [0.5, 0.25]), (2, [3.0, -1.0]), (9, [1e30, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.id is not None, r.id or 0, r.component) for r in got) == sorted((k is not None, k or 0, c) for k in (None, 1, 2, 2) for c in (1, 2))
    assert {r.n for r in got} == {4} and {r.identity_error for r in got}.pop() < 1e-12


def test_without_variance_or_rows(spark):
    schema = "vec_id bigint, embedding array<float>, n string, id string"
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", "y")] * 3, schema)).count() == 0
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "x", "y") for i in range(9)], schema)
    assert {r.component for r in whiten(line).collect()} == {1}


def test_deviations_are_exact_or_null():
    big = Fit.of(3, [3 * 2**40, 0])
    assert deviations(np.array([[2**40 + 1, -1]]), big) == [18]
    assert deviations(np.array([[2**40 + 2**31, 0]]), big) == [None]
    assert deviations(np.array([[2**40 + 2**29, 1]]), big) == [9 * 2**58 + 9]


def test_components_fall_and_have_unit_length():
    a = np.diag([1.0, 5.0, 3.0, 0.0])
    values, axes = components(a, 8)
    assert values.tolist() == [5.0, 3.0, 1.0] and np.allclose(axes.T @ axes, np.eye(3))
