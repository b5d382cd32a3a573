"""The whitening operator against floating-point eigenvectors and exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from planmatch.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, key string, component int, whitened string"


def table(rows_of, vectors, parts=3):
    return rows_of(SCHEMA, [(i, v, "x", 1, "y") for i, v in vectors], parts)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]


def check(got, kept, most=8):
    """Rows of the operator against plain arithmetic over the kept (id, x) pairs."""
    x = np.array([v for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    centred = x - np.array([Fraction(int(s), n) for s in sums], object)
    v = (centred.T @ centred / n).astype(np.float64)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    width = min(most, int((e > 1e-6).sum()))
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for i, row in kept}
    white = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["key"]]
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9
        assert r["identity_error"] < 1e-9
        white[r["key"], r["component"]] = r["whitened"]
    assert set(white) == {(i, c) for i, _ in kept for c in range(1, width + 1)}
    out = np.array([[white[i, c] for c in range(1, width + 1)] for i, _ in kept])
    assert np.abs(out.T @ out / n - np.eye(width)).max() < 1e-9
    for c in range(width):
        if min([abs(e[c] - o) for k, o in enumerate(e) if k != c], default=1) > 1e-6 * e[0]:
            want = centred.astype(np.float64) @ axes[:, c] / math.sqrt(e[c])
            assert min(np.abs(out[:, c] - want).max(), np.abs(out[:, c] + want).max()) < 1e-8


def test_against_floats(rows_of):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(rng.normal(size=(60, 12)) * 0.3)]
    bad = [(100, None), (101, []), (102, [float("nan")] * 12), (103, [None] + [0.5] * 11), (104, [float("inf")] * 12), (105, [1.0])]
    got = W.whiten(table(rows_of, vectors + bad)).collect()
    check(got, [(i, whole(v)) for i, v in vectors])


def test_equal_variances_and_directions_without_any(rows_of):
    # Two pairs of equal variances, a constant direction.
    rows = [[a, b, c, d, 0.5] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-2.0, 2.0) for d in (-2.0, 2.0)]
    vectors = list(enumerate(rows))
    got = W.whiten(table(rows_of, vectors)).collect()
    check(got, [(i, whole(v)) for i, v in vectors])
    assert {r["component"] for r in got} == {1, 2, 3, 4}


def test_single_vector_repeats_and_empty(rows_of):
    got = W.whiten(table(rows_of, [(1, [0.1, 0.2]), (1, [0.1, 0.2])])).collect()
    assert [(r["key"], r["component"], r["n"], r["deviation"], r["whitened"]) for r in got] == [(1, 1, 2, 0, None)] * 2
    empty = W.whiten(table(rows_of, [(1, None)]))
    assert empty.count() == 0 and empty.columns[0] == "key"


def test_entries_at_the_ends_of_a_long(rows_of):
    vectors = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])]
    got = {(r["key"], r["component"]): r for r in W.whiten(table(rows_of, vectors)).collect()}
    x = [[(1 << 63) - 1, 100000], [-(1 << 63), 101024], [100000, 105120]]
    sums = [sum(c) for c in zip(*x)]
    for key, row in zip((1, 2, 3), x):
        exact = sum((3 * a - s) ** 2 for a, s in zip(row, sums))
        assert got[key, 1]["deviation"] == (exact if exact < 10**38 else None)
    assert abs(got[3, 2]["whitened"]) > 1 and got[1, 1]["identity_error"] < 1e-6


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_by_remainders(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-9, 10, (d, d + 1))
    m = (a @ a.T).tolist()
    # Faddeev-LeVerrier, exact.
    c, work = [0] * d + [1], np.eye(d, dtype=object)
    big = np.array(m, object)
    for k in range(1, d + 1):
        step = big @ work
        c[d - k] = -int(np.trace(step)) // k
        work = step + np.eye(d, dtype=object) * c[d - k]
    assert W.characteristic_polynomial(spark, m) == c


def test_roots_are_counted_and_isolated():
    # (t - 2)^3 (t - 7) (t - 7.0000001) t^2, the last but one scaled to whole numbers.
    poly = np.array([1], object)
    for root in [2 * 10**7] * 3 + [7 * 10**7, 70000001, 0, 0]:
        poly = np.convolve(poly, np.array([1, -root], object))
    roots = W.RealRooted([int(c) for c in poly[::-1]]).largest(8, 64)
    assert [r.times for r in roots] == [1, 1, 3]
    for r, want in zip(roots, (70000001, 7 * 10**7, 2 * 10**7)):
        assert r.low <= want << r.places <= r.high and r.high - r.low <= r.high >> 64


def test_digits_rebuild_numbers():
    z = np.array([0, 1, -1, 2**19, -(2**19), 2**40 + 12345, -(2**62)], np.int64)
    parts = W.digits(z)
    assert all(np.abs(p).max() <= 2**19 for p in parts)
    assert [sum(int(p[i]) << (W.DIGIT * k) for k, p in enumerate(parts)) for i in range(len(z))] == z.tolist()
