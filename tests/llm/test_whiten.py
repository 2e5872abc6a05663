"""Whitening against Fractions, plain eigenvectors and brute force on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lakescreen.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_polynomial(a):
    """Faddeev-LeVerrier with fractions."""
    d = len(a)
    one = [[Fraction(i == j) for j in range(d)] for i in range(d)]
    mul = lambda x, y: [[sum(x[i][k] * y[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = mul(a, m)
        m = [[m[i][j] + c[-1] * one[i][j] for j in range(d)] for i in range(d)]
        am = mul(a, m)
        c.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(v) for v in c]


def scatter(x):
    n, s = len(x), [sum(r[j] for r in x) for j in range(len(x[0]))]
    return [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]


@pytest.mark.parametrize("kind", ["dense", "low rank", "diagonal", "repeated", "huge"])
def test_polynomials_roots_and_null_spaces(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "dense": rng.integers(-60, 60, (40, 7)),
        "low rank": np.c_[rng.integers(-9, 9, (30, 3)), np.ones((30, 2), int), np.arange(30)[:, None] * 3, np.arange(30)[:, None]],
        "diagonal": np.vstack([np.diag([1, 2, 3, 4, 5]), -np.diag([1, 2, 3, 4, 5])]),
        "repeated": np.vstack([np.eye(6, dtype=int) * 7, -np.eye(6, dtype=int) * 7]),
        "huge": rng.integers(-(2**60), 2**60, (25, 4)),
    }[kind].tolist()
    a = scatter(x)
    d, trace = len(a), sum(a[k][k] for k in range(len(a)))
    assert [[int(v) for v in r] for r in len(x) * whiten.products(np.array(x)) - np.outer(*[np.array(x).astype(object).sum(0)] * 2)] == a
    c = whiten.polynomials(spark, {d: a})[d]
    assert c == plain_polynomial([[Fraction(v) for v in row] for row in a])
    roots, point = whiten.largest_roots(c, trace, d)
    rank = np.linalg.matrix_rank(np.array(x, float) - np.array(x, float).mean(0))
    assert sum(m for _, m in roots) == rank
    plain = np.linalg.eigvalsh(np.array(a, float))[::-1][:rank]
    mine = [r / 2**point for r, m in roots for _ in range(m)]
    assert np.allclose(mine, plain, rtol=1e-9) and mine == sorted(mine, reverse=True)
    for root, size in roots:
        u = whiten.null_space(np.array(a, object).reshape(d, d), root, point, size)
        assert np.allclose(u @ u.T, np.eye(size), atol=1e-14)
        assert np.abs(np.array(a, float) @ u.T - u.T * (root / 2**point)).max() < 1e-13 * trace
    if kind == "repeated":
        assert [m for _, m in roots] == [6]


def test_a_pair_of_close_roots_is_told_apart(spark):
    a = [[10**12, 1], [1, 10**12 + 1]]
    roots, point = whiten.largest_roots(whiten.polynomials(spark, {2: a})[2], 2 * 10**12 + 1, 2)
    assert [m for _, m in roots] == [1, 1]
    assert abs((roots[0][0] - roots[1][0]) / 2**point - math.sqrt(5)) < 1e-12
    u = np.vstack([whiten.null_space(np.array(a, object), r, point, 1) for r, _ in roots])
    want = math.atan(2 / -1) / 2  # the angle of the components, by hand
    assert abs(abs(u[1] @ [math.cos(want), math.sin(want)]) - 1) < 1e-15 or abs(abs(u[0] @ [math.cos(want), math.sin(want)]) - 1) < 1e-15


def brute(rows, most=32):
    """Whitened rows by plain double precision."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], float)
    centred = x - x.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return x, e, centred @ u / np.sqrt(e)


def test_rows_of_the_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    good = [(int(k), rng.normal(size=6).tolist()) for k in [*range(50), 7, 7]]
    good += [(None, good[3][1]), (60, good[3][1])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0]), (903, [math.inf] * 6), (904, []), (905, [1e300] * 6)]
    table = [(k, v, 0, "x", 1) for k, v in [*good, *bad]]
    spark.createDataFrame(table, SCHEMA + ", component string, n int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op13_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes) | {"n": "bigint", "deviation": "bigint", "component": "int"} == dict(got.dtypes)
    got = got.collect()
    x, e, w = brute(good)
    n, s = len(good), x.astype(int).sum(0)
    deviation = [int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True))) for r in x]
    assert len(got) == 6 * n and {r.n for r in got} == {n}
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((-1 if k is None else k, d) for (k, _), d in zip(good, deviation, strict=True))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    mine = np.array([[by[k, d][c + 1] for c in range(6)] for (k, _), d in zip(good, deviation, strict=True)])
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-10
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[c + 1] for c in range(6)], e / e.sum(), rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12


def test_few_components_equal_vectors_lengths_and_empty_tables(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=5).tolist(), 0) for k in range(30)] + [(100 + k, rng.normal(size=3).tolist(), 0) for k in range(20)]
    rows += [(200 + k, [0.5, 0.25], 0) for k in range(9)] + [(300, [1.0] * 4, 0)]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), most=4).collect()
    assert {(r.vec_id, r.component) for r in got} == {(k, c) for k in range(30) for c in (1, 2, 3, 4)} | {(100 + k, c) for k in range(20) for c in (1, 2, 3)}
    assert {r.vec_id // 100: r.n for r in got} == {0: 30, 1: 20}
    assert whiten.whiten(spark.createDataFrame(rows[50:], SCHEMA)).count() == 0
    assert whiten.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_deviation_beyond_64_bits_is_null(spark):
    rows = [(0, [2.0**50, 0.0], 0), (1, [-(2.0**50), 1.0], 0), (2, [0.0, 0.5], 0)]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.deviation is None for r in got} == {0: True, 1: True, 2: False}
    assert got[0].identity_error < 1e-9
