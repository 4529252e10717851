"""Nested levels against the full normal equations in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.operators import nested
from convoscope.operators.moments import Moments, merge_all, moment_table


def rows(seed=1, papers=4):
    rng = np.random.default_rng(seed)
    out = []
    for p in range(papers):
        u = rng.normal(size=3) * [5, 1, 0.05]
        for c in range(3):
            v = u + rng.normal(size=3) * [3, 0.6, 0.03]
            for g in range(rng.integers(1, 6)):
                w = v + rng.normal(size=3) * [2, 0.4, 0.02]
                for _ in range(rng.integers(1, 25)):
                    rep, trial = rng.integers(1, 7), rng.integers(1, 73)
                    y = 40 + w[0] + (w[1] - 3) * rep + (w[2] + 0.1) * trial + rng.normal() * 2
                    out.append((f"p{p}", None if c == 2 else c, f"g{g}", float(rep), float(trial), float(y)))
    return out


def dense(data, spread, sigma2, centre):
    """Coefficients of all and of every group from one big penalised system."""
    keys = [sorted({r[: i + 1] for r in data}, key=str) for i in range(3)]
    at, off = {}, 3
    for level in keys:
        for k in level:
            at[k] = off
            off += 3
    x = np.zeros((len(data), off))
    for n, r in enumerate(data):
        base = [1.0, r[3] - centre[0], r[4] - centre[1]]
        x[n, :3] = base
        for i in range(3):
            x[n, at[r[: i + 1]] : at[r[: i + 1]] + 3] = base
    penalty = np.zeros((off, off))
    for i, level in enumerate(keys):
        for k in level:
            a = at[k]
            penalty[a : a + 3, a : a + 3] = np.linalg.inv(spread[i])
    y = np.array([r[5] for r in data]) - centre[2]
    inv = np.linalg.inv(x.T @ x / sigma2 + penalty)
    b = inv @ (x.T @ y) / sigma2
    squares, counts = [], []
    for level in keys:
        squares.append(sum(np.outer(b[at[k] : at[k] + 3], b[at[k] : at[k] + 3]) + inv[at[k] : at[k] + 3, at[k] : at[k] + 3] for k in level))
        counts.append(len(level))
    res = y - x @ b
    new_sigma2 = (res @ res + np.trace(x.T @ x @ inv)) / len(data)
    total = {(): b[:3]}
    for level in keys:
        for k in level:
            total[k] = total[k[:-1]] + b[at[k] : at[k] + 3]
    return total, [s / c for s, c in zip(squares, counts, strict=True)], new_sigma2


def fitted(spark, data, rounds):
    df = spark.createDataFrame(data, "paper string, cond int, game string, rep double, trial double, y double").repartition(3)
    return nested.fit(df, ["paper", "cond", "game"], {"rep": F.col("rep"), "trial": F.col("trial")}, F.col("y"), rounds)


@pytest.mark.parametrize("few", [100_000, 0])
def test_estimates_equal_the_full_normal_equations(spark, monkeypatch, few):
    monkeypatch.setattr(nested, "BROADCAST_GROUPS", few)
    data = rows()
    model = fitted(spark, data, 2)
    total, *_ = dense(data, model.spread, model.sigma2, model.centre)
    assert np.allclose(model.beta, total[()], atol=1e-8)
    got = {}
    for r in nested.coefficients(model).collect():
        key = () if r.level == "all" else tuple(r[k] for k in model.levels[: model.levels.index(r.level) + 1])
        got[key] = (r.intercept, r.rep, r.trial, r.n)
    assert set(got) == set(total)
    for key, b in total.items():
        intercept = b[0] + model.centre[2] - b[1:] @ model.centre[:2]
        assert np.allclose(got[key][:3], [intercept, *b[1:]], atol=1e-7), key
        assert got[key][3] == sum(r[: len(key)] == key for r in data)


def test_variances_follow_expectation_maximisation(spark):
    data = rows(2, 3)
    start, one, two = (fitted(spark, data, k) for k in (0, 1, 2))
    for before, after in ((start, one), (one, two)):
        _, spread, sigma2 = dense(data, before.spread, before.sigma2, before.centre)
        assert np.isclose(after.sigma2, sigma2, rtol=1e-8)
        for a, b in zip(after.spread, spread, strict=True):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_no_rows_and_rank(spark):
    with pytest.raises(ValueError, match="no rows"):
        fitted(spark, [], 1)
    with pytest.raises(ValueError, match="full rank"):
        fitted(spark, [("a", 1, "g", float(k), 2.0 * k, 1.0 * k * k) for k in range(9)], 1)


def test_moments_merge_far_from_zero(spark):
    """A mean a million times the spread: raw sums of squares would lose every digit."""
    rng = np.random.default_rng(4)
    x = 1e6 + rng.normal(size=(3000, 2))
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=3000)
    data = [(int(k % 4), float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(1, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "fold int, a double, b double, y double").repartition(5)
    cols = {c: F.col(c) for c in ("a", "b", "y")}
    parts = [Moments.of(cols, r) for r in moment_table(df, cols, ["fold"]).collect()]
    m = merge_all(parts)
    full = np.column_stack([x, y])
    assert m.n == 3000 and np.allclose(m.mean, full.mean(axis=0), rtol=1e-12)
    assert np.allclose(m.cross, np.cov(full.T, ddof=0) * 3000, rtol=1e-6)
    beta = np.array([0.5, 2.0, -1.0])
    assert np.isclose(m.squared_error(beta), ((y - 0.5 - 2 * x[:, 0] + x[:, 1]) ** 2).sum(), rtol=1e-6)
