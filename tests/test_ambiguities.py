import itertools
import math

import numpy as np
import pytest

from tecflow.operators import ambiguities as A


def exhaustive(value, covariance, reach=6):
    weight, near = np.linalg.inv(covariance), np.rint(value)
    scored = []
    for step in itertools.product(range(-reach, reach + 1), repeat=len(value)):
        v = near + step
        scored.append(((value - v) @ weight @ (value - v), tuple(int(x) for x in v)))
    scored.sort()
    return scored[0][1], scored[1][0] / scored[0][0]


def random_group(rng, n, along=0.4, noise=0.03):
    u = rng.normal(0, along, (n, 2))
    cov = u @ u.T + np.diag(rng.uniform(noise / 2, noise, n))
    return rng.uniform(-30, 30, n), cov


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_exhaustive_search(n):
    rng = np.random.default_rng(n)
    for _ in range(120):
        value, cov = random_group(rng, n)
        got, ratio, success = A.solved_group(value, cov)
        want, want_ratio = exhaustive(value, cov)
        assert tuple(got) == want and math.isclose(ratio, want_ratio, rel_tol=1e-6) and 0 < success <= 1


def test_reduction_keeps_the_lattice_and_shortens_it():
    rng = np.random.default_rng(5)
    for n in (2, 5, 12):
        value, cov = random_group(rng, n, 3.0, 0.001)
        r0 = np.linalg.cholesky(np.linalg.inv(cov)).T
        r, z = A.reduced(r0)
        assert abs(round(np.linalg.det(z))) == 1 and np.allclose(np.tril(r, -1), 0)
        assert np.allclose((r0 @ z).T @ (r0 @ z), r.T @ r, rtol=1e-6, atol=1e-6 * np.abs(r).max() ** 2)
        assert np.abs(np.diag(r)).min() >= np.abs(np.diag(r0)).min() * 0.999


def test_planted_numbers_are_found_in_many_groups(spark):
    rng, rows, truth = np.random.default_rng(6), [], {}
    for k in range(60):
        n = int(rng.integers(4, 15))
        _, cov = random_group(rng, n, 0.8, 0.0004)
        whole = rng.integers(-50, 50, n)
        value = whole + np.linalg.cholesky(cov) @ rng.normal(size=n)
        truth[k] = whole
        rows.append((k, [f"G{i:02d}" for i in range(n)], list(map(float, value)), list(map(float, cov.ravel()))))
    rows += [(100, [], [], []), (101, ["G01"], [None], [1.0]), (102, ["G01", "G02"], [1.0, 2.0], [1.0, 2.0, 2.0, 1.0]), (103, ["G01"], [1.2], [1.0, 2.0]), (104, None, None, None), (105, ["G01", "G02"], [0.5, 0.5], [1.0, 0.0, 0.0, 1.0]), (106, ["G01"], [3.0], [0.01])]
    df = spark.createDataFrame(rows, "k int, names array<string>, values array<double>, covariance array<double>")
    got = A.fixed(df, ["k"]).collect()
    right = sum(r.fixed == truth[r.k][int(r.name[1:])] for r in got if r.k < 100)
    wrong = sum(r.fixed is not None and r.fixed != truth[r.k][int(r.name[1:])] for r in got if r.k < 100)
    assert right > 0.8 * sum(map(len, truth.values())) and wrong <= 0.02 * right
    assert all(r.fixed is None for r in got if 100 <= r.k <= 105)
    assert [(r.fixed, r.n) for r in got if r.k == 106] == [(3, 1)]


def test_the_loosest_goes_first(spark):
    cov = np.diag([1e-4] * 5 + [9.0])
    df = spark.createDataFrame([(1, list("abcdef"), [1.01, 2.0, 2.99, 4.0, 5.01, 7.45], list(map(float, cov.ravel())))], "k int, names array<string>, values array<double>, covariance array<double>")
    got = {r.name: r for r in A.fixed(df, ["k"]).collect()}
    assert [got[c].fixed for c in "abcdef"] == [1, 2, 3, 4, 5, None] and got["a"].n == 5
