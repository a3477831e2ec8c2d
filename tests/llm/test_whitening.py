"""Whitening against big rational numbers."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16):
    """n, S, the exact covariance, and each row's deviation, all in Python's integers."""
    xs = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v, _ in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return xs, n, s, v, {k: sum((n * a - b) ** 2 for a, b in zip(x, s)) for k, x in xs.items()}


def made(seed, n, d, spread=1.0):
    rng = random.Random(seed)
    base = [[rng.gauss(0, spread * (0.2 + (j % 5))) for j in range(d)] for _ in range(n)]
    return [(k, v, 0) for k, v in enumerate(base)] + [(n + k, base[0], 1) for k in range(n // 2)]


@pytest.mark.parametrize("seed,n,d,spread", [(1, 60, 5, 1.0), (2, 40, 20, 0.3), (3, 50, 4, 1e6), (4, 30, 3, 1e13), (5, 10, 18, 0.5)])
def test_against_rational_numbers(spark, seed, n, d, spread):
    rows = made(seed, n, d, spread)
    xs, count, s, v, deviation = brute(rows)
    got = W.whitened(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    k = min(16, d)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i in xs for c in range(1, k + 1))
    assert {r["n"] for r in got} == {count} and len({r["identity_error"] for r in got}) == 1
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: x if x < 2**63 else None for i, x in deviation.items()}
    dense = np.array([[float(c) for c in row] for row in v])
    values = np.linalg.eigvalsh(dense)[::-1][:k]
    trace = float(sum(v[i][i] for i in range(d)))
    live = [c for c in range(k) if values[c] > values[0] * 1e-12]
    assert len(live) == min(k, count - 1)
    for r in got:
        c = r["component"] - 1
        assert (r["whitened"] is not None) == (c in live)
        assert r["explained"] == (pytest.approx(values[c] / trace, rel=1e-9) if c in live else 0.0)
    # whitened values of the distinct vectors: unit covariance, and directions that V only stretches
    first = {tuple(x): i for i, x in sorted(xs.items(), reverse=True)}
    w = np.array([[next(r["whitened"] for r in got if r["vec_id"] == i and r["component"] == c + 1) for c in live] for i in first.values()])
    y = np.array([[float(Fraction(count * a - b, count)) for a, b in zip(x, s)] for x in first])
    error = np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / count - np.eye(len(live))).max()
    assert error < 1e-7 and got[0]["identity_error"] < 1e-4
    assert np.allclose(w.T @ y / count, (w.T @ y / count @ dense) / values[live][:, None], rtol=1e-6, atol=1e-9 * math.sqrt(values[0]))
    by = {}
    for r in got:
        by.setdefault((tuple(xs[r["vec_id"]]), r["component"]), set()).add(r["whitened"])
    assert all(x == {None} or max(x) - min(x) < 1e-9 for x in by.values())  # copies have the same values


@pytest.mark.parametrize("bits", [10, 25, 41, 61])
def test_products_are_exact(bits):
    rng = random.Random(bits)
    y = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(3)] for _ in range(5000)], object)
    want = y.T @ y
    for kind in (object, np.int64):
        count = (bits + 1) // W.DIGIT + 1
        got = W.products(y.astype(kind), count)
        assert (sum(m.astype(object) * (1 << (W.DIGIT * w)) for w, m in enumerate(got)) == want).all()


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -0.25], 1), (1, [0.5, -0.25], 1), (None, [1.5, 2.0], None), (2, [-3.0, 0.0], 0)]
    bad = [(3, None, 0), (4, [], 0), (5, [None, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, nan], 0), (8, [-inf, 1.0], 0), (9, [1.0, 2.0, 3.0], 0)]
    df = spark.createDataFrame([(*r, "a", 5) for r in good + bad], SCHEMA + ", x string, key int")
    got = W.whitened(spark, df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert got[0]["n"] == 3 and got[0]["identity_error"] < 1e-9
    one = W.whitened(spark, df.filter("vec_id = 1")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None)] * 4
    assert W.whitened(spark, df.filter("vec_id > 2 and vec_id < 9")).count() == 0 and W.whitened(spark, df.filter("false")).count() == 0
    far = W.whitened(spark, spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 2.0], 0)], SCHEMA)).collect()
    assert len(far) == 6 and all(r["deviation"] is None for r in far if r["vec_id"] < 3)
