"""Whitening against exact fractions and plain linear algebra."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

ROW = "vec_id long, embedding array<float>"


def plain(rows):
    """Floors, exact means and covariance of different vectors, by fractions."""
    x = {k: [int(np.floor(float(np.float32(c)) * 256)) for c in v] for k, v in rows.items()}
    different = sorted({tuple(v) for v in x.values()})
    n, dims = len(different), len(different[0])
    sums = [sum(v[j] for v in different) for j in range(dims)]
    centre = [Fraction(s, n) for s in sums]
    cov = [[sum((v[i] - centre[i]) * (v[j] - centre[j]) for v in different) / n for j in range(dims)] for i in range(dims)]
    return x, n, sums, cov


def vectors(n=60, dims=6, seed=2):
    rnd = random.Random(seed)
    scale = [3, 1, 0.3, 5, 0.5, 2]
    rows = {k: [rnd.gauss(40, 1) * scale[j % 6] for j in range(dims)] for k in range(n)}
    rows[n] = list(rows[0])
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_against_fractions(spark, parts):
    rows = vectors()
    x, n, sums, cov = plain(rows)
    values, q = np.linalg.eigh(np.array(cov, float))
    values, q = values[::-1], q[:, ::-1]
    got = whitening.whiten(spark.createDataFrame(list(rows.items()), ROW).repartition(parts)).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        v, k = x[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums)) == int(r["deviation_exact"])
        want = float(np.dot([float(a - Fraction(s, n)) for a, s in zip(v, sums)], q[:, k]) / values[k] ** 0.5)
        signs.setdefault(k, np.sign(want * r["whitened"]))
        assert r["whitened"] == pytest.approx(signs[k] * want, abs=1e-9)
        assert r["explained"] == pytest.approx(values[k] / float(sum(cov[j][j] for j in range(6))), rel=1e-10) and r["identity_error"] < 1e-10


def test_scatter_is_exact_for_large_entries(spark):
    rnd = random.Random(4)
    rows = [[rnd.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(50)]
    got = whitening.scatter(spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3), 3)
    full = [[1, *r] for r in rows]
    assert got == [[sum(r[i] * r[j] for r in full) for j in range(4)] for i in range(4)]


def test_primes_and_remainders():
    primes = whitening.primes_for(10**60)
    assert all(p < whitening.PRIMES_BELOW and all(p % k for k in range(2, 1500)) for p in primes) and len(set(primes)) == len(primes)
    for v in (0, 1, -1, 10**60, -(10**60), 123456789**5):
        assert whitening.remaindered([v % p for p in primes], primes) == v


def test_small_components_beside_large_ones_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-3, 4, (300, 6)).astype(float)
    a[:, 0] *= 3e6
    a[:, 1] *= 1e5
    a[:, 2] *= 10
    a[:, 3] += 1e6
    a[0, 0] -= 1
    got = whitening.whiten(spark.createDataFrame([(i, (r / 256).tolist()) for i, r in enumerate(a)], "vec_id long, embedding array<double>")).collect()
    assert {r["identity_error"] < 1e-6 for r in got} == {True}
    by = {r["component"]: r["explained"] for r in got}
    cov = plain_cov(a)
    trace = sum(cov[j][j] for j in range(6))
    # the large directions are nearly the axes: what is left for the others is the Schur complement, in exact fractions
    rest = schur(cov, 2)
    small = np.sort(np.linalg.eigvalsh(np.array(rest, float)))[::-1][:2]
    assert by[3] == pytest.approx(small[0] / float(trace), rel=1e-5) and by[4] == pytest.approx(small[1] / float(trace), rel=1e-5)


def plain_cov(a):
    rows = sorted({tuple(int(v) for v in r) for r in a})
    n, dims = len(rows), len(rows[0])
    centre = [Fraction(sum(r[j] for r in rows), n) for j in range(dims)]
    return [[sum((r[i] - centre[i]) * (r[j] - centre[j]) for r in rows) / n for j in range(dims)] for i in range(dims)]


def schur(m, k):
    m = [row[:] for row in m]
    for p in range(k):
        for i in range(p + 1, len(m)):
            f = m[i][p] / m[p][p]
            m[i] = [a - f * b for a, b in zip(m[i], m[p])]
    return [row[k:] for row in m[k:]]


def test_edges(spark):
    many = [(1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (3, [float("inf"), 1.0], 0), (4, [1.0, 2.0], 0), (4, [1.0, 2.0], 1), (None, [3.0, 2.0], 0), (7, [1.0], 0), (9, [-0.0, 2.0], None)]
    schema = "vec_id long, embedding array<double>, n int"
    got = whitening.whiten(spark.createDataFrame(many, schema)).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((i, c, 3) for i in ("4", "4", "9", "None") for c in (1, 2))
    assert all(r["whitened"] is None and r["explained"] == 0 for r in got if r["component"] == 2)
    same = whitening.whiten(spark.createDataFrame(many[4:6], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    for rows in ([], many[:1], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [0.0, 1.0], 0)], schema)).collect()
    assert {(r["deviation"], int(r["deviation_exact"])) for r in huge} == {(None, whitening.LONG**2)}
