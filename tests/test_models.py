import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.operators import models as md


def test_closed_form_ols_matches_lstsq(spark):
    rng = np.random.default_rng(2)
    x1 = rng.integers(1, 7, 400)
    x2 = rng.integers(1, 73, 400)
    y = 30 - 2.5 * x1 + 0.1 * x2 + rng.normal(0, 3, 400)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 int, x2 int, y double")
    fit = md.ols(df, {"x1": F.col("x1"), "x2": F.col("x2")}, F.col("y"))
    X = np.column_stack([np.ones(400), x1, x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (400 - 3)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(X.T @ X)))
    table = md.coef_table(spark, fit, "m").collect()
    assert np.allclose([r.estimate for r in table], beta, atol=1e-6)
    assert np.allclose([r.std_error for r in table], se, atol=1e-6)
    assert np.isclose(table[0].r2, 1 - resid @ resid / ((y - y.mean()) ** 2).sum(), atol=1e-6)


def test_fit_far_from_zero(spark):
    """A response and a term with means a million times their spread."""
    rng = np.random.default_rng(9)
    x = 1e6 + rng.normal(size=2000)
    y = 3e6 + 2 * (x - 1e6) + rng.normal(size=2000) * 0.1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(7)
    fit = md.ols(df, {"x": F.col("x")}, F.col("y"))
    assert abs(fit.beta[1] - 2) < 0.01 and abs(fit.sigma2 - 0.01) < 0.001 and abs(fit.r2 - 0.9975) < 0.001


def test_irls_logit(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 4000).round(1)
    p = 1 / (1 + np.exp(-(-1.0 + 3.0 * x)))
    y = (rng.uniform(size=4000) < p).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "grp string, frac double, hit int")
    r = md.logit_by_group(df, "grp", "frac", "hit").collect()[0]
    assert abs(r["intercept"] + 1.0) < 0.25 and abs(r["slope"] - 3.0) < 0.5


def test_shrinkage_weights_between_0_and_1(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        b = rng.normal(-2, 1)
        for _ in range(50):
            x = int(rng.integers(1, 7))
            rows.append((f"g{g}", x, float(20 + b * x + rng.normal(0, 2))))
    df = spark.createDataFrame(rows, "grp string, x int, y double")
    out = md.group_shrinkage(df, "grp", "x", "y").collect()
    assert len(out) == 6
    for r in out:
        assert 0 <= r["weight"] <= 1
        lo, hi = sorted([r["slope"], r["pooled_slope"]])
        assert lo - 1e-6 <= r["shrunk_slope"] <= hi + 1e-6


def test_shrinkage_keeps_every_group(spark):
    rows = [("few", 1, 3.0), ("flat", 2, 1.0), ("flat", 2, 2.0), ("flat", 2, 4.0), ("line", 1, 1.0), ("line", 2, 2.0), ("line", 3, 3.0)]
    rows += [(g, x, 10.0 - s * x + (-1) ** x) for g, s in (("a", 1.0), ("b", 2.0)) for x in range(1, 7)]
    got = {r["grp"]: r for r in md.group_shrinkage(spark.createDataFrame(rows, "grp string, x int, y double"), "grp", "x", "y").collect()}
    assert set(got) == {"few", "flat", "line", "a", "b"}
    assert got["few"]["weight"] == got["flat"]["weight"] == 0.0 and got["few"]["shrunk_slope"] == got["few"]["pooled_slope"]
    assert got["line"]["weight"] == 1.0 and got["line"]["shrunk_slope"] == 1.0


def test_logit_reports_convergence(spark):
    rows = [("ok", x / 10, int(x * 7 % 10 < x)) for x in range(10) for _ in range(3)] + [("ok", 0.9, 0), ("ok", 0.1, 1)] + [("sep", x / 10, int(x > 4)) for x in range(10)]
    got = {r["grp"]: r["converged"] for r in md.logit_by_group(spark.createDataFrame(rows, "grp string, x double, hit int"), "grp", "x", "hit").collect()}
    assert got == {"ok": True, "sep": False}


def test_all_logistic_fits_at_once(spark):
    """Several flags and groupings, NULL groups kept, against Newton's method in numpy."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(900):
        g, t, x = [None, "a", "b"][k % 3], "ABCD"[k % 4], float(rng.integers(0, 7)) / 6
        rows.append((g, t, x, int(rng.random() < 1 / (1 + np.exp(1 - 2 * x))), None if k % 50 == 0 else int(rng.random() < 0.4), 1))
    df = spark.createDataFrame(rows, "g string, t string, x double, one int, two int, every int").repartition(4)
    got = {(r.flag, r.grouping, r.grp): r for r in md.logit_by_groups(df, {"g": F.col("g"), "t": F.col("t")}, "x", ["one", "two", "every"]).collect()}
    assert len(got) == 3 * (3 + 4)
    for (flag, grouping, grp), r in got.items():
        at, y_at = {"g": 0, "t": 1}[grouping], {"one": 3, "two": 4, "every": 5}[flag]
        use = [q for q in rows if q[at] == grp and q[y_at] is not None]
        assert r.n == len(use)
        if flag == "every":
            assert not r.converged
            continue
        X, y, beta = np.column_stack([np.ones(len(use)), [q[2] for q in use]]), np.array([q[y_at] for q in use], float), np.zeros(2)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-X @ beta))
            beta = beta + np.linalg.solve(X.T @ (X * (mu * (1 - mu))[:, None]), X.T @ (y - mu))
        assert r.converged and np.allclose([r.intercept, r.slope], beta, atol=1e-5)


def _frame(spark, n=500, seed=6):
    rng = np.random.default_rng(seed)
    rep, trial = rng.integers(1, 7, n), rng.integers(1, 73, n)
    y = 30 - 2.5 * rep + 0.2 * rep**2 + 0.1 * trial - 0.001 * trial**2 + rng.normal(0, 2, n)
    rows = [(f"k{i}", int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(rep, trial, y))]
    return spark.createDataFrame(rows, "key string, rep_num int, trial_num int, y double"), np.column_stack([np.ones(n), rep, rep**2, trial, trial**2]), y


def test_ols_of_any_terms_matches_lstsq(spark):
    df, X, y = _frame(spark)
    fit = md.ols(df, md.quadratic_terms(), F.col("y"))
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = ((y - X @ beta) ** 2).sum() / (len(y) - 5)
    assert np.allclose(fit.beta, beta, rtol=1e-6) and np.isclose(fit.sigma2, s2)
    assert np.allclose(np.diag(fit.cov), s2 * np.diag(np.linalg.inv(X.T @ X)), rtol=1e-5)
    grid = spark.createDataFrame([(2, 10.0)], "rep_num int, trial_num double")
    row = md.ols_predict(fit, grid, md.quadratic_terms(), "q").first()
    x = np.array([1, 2, 4, 10, 100.0])
    half = md.Z95 * np.sqrt(x @ (s2 * np.linalg.inv(X.T @ X)) @ x)
    assert np.allclose([row.estimate, row.q2_5, row.q97_5], [x @ beta, x @ beta - half, x @ beta + half], atol=1e-5)


def test_quadratic_folds_match_numpy(spark):
    import hashlib

    df, X, y = _frame(spark)
    fold = np.array([int(hashlib.md5(f"k{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(len(y))])
    columns = {**md.form_terms(), "y": F.col("y")}
    folds = md.fold_moments(df, columns, "key")
    rows = md.compare_forms(spark, folds, md.FORMS, "y").collect()
    got = {r.fold: r for r in rows if r.model == "quadratic"}
    total = 0.0
    for k in range(5):
        beta, *_ = np.linalg.lstsq(X[fold != k], y[fold != k], rcond=None)
        s2 = ((y[fold != k] - X[fold != k] @ beta) ** 2).sum() / ((fold != k).sum() - 5)
        r = y[fold == k] - X[fold == k] @ beta
        density = (-0.5 * np.log(2 * np.pi * s2) - r * r / (2 * s2)).sum()
        total += density
        assert got[k].n_test == len(r) and np.isclose(got[k].rmse, np.sqrt((r**2).mean()), atol=1e-5)
        assert np.isclose(got[k].log_density, density, atol=1e-3)
    assert np.isclose(got[0].model_log_density, total, atol=1e-3)
    assert {r.model: r.model_rank for r in rows}["quadratic"] == 1  # the rows are quadratic
    assert sorted({r.model: r.model_rank for r in rows}.values()) == [1, 2, 3]


def test_forms_share_one_read(spark, tmp_path):
    df, *_ = _frame(spark)
    df.write.parquet(f"{tmp_path}/t")
    columns = {**md.form_terms(), "y": F.col("y")}
    table = md.moment_table(spark.read.parquet(f"{tmp_path}/t"), columns, [md.fold_of("key").alias("fold")])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_rank_deficient_terms_raise(spark):
    df, _, _ = _frame(spark)
    with pytest.raises(ValueError, match="full rank"):
        md.ols(df, {"a": F.col("rep_num"), "b": F.col("rep_num") * 2}, F.col("y"))


def test_interactions_match_lstsq(spark):
    rng = np.random.default_rng(1)
    n = 400
    a, f = rng.integers(1, 7, n), rng.choice(["x", "y", "z"], n)
    y = 1 + a * (0.5 + (f == "y")) + 2 * (f == "z") + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(int(p), str(q), float(r)) for p, q, r in zip(a, f, y)], "a int, f string, y double")
    terms = md.interaction_terms({"a": F.col("a")}, {"f": (F.col("f"), ["x", "y", "z"])})
    assert list(terms) == ["a", "f=y", "f=z", "a:f=y", "a:f=z"]
    X = np.column_stack([np.ones(n), a, f == "y", f == "z", a * (f == "y"), a * (f == "z")]).astype(float)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert np.allclose(md.ols(df, terms, F.col("y")).beta, beta, atol=1e-8)


def test_factor_fit_equals_the_wide_design(spark):
    """Differences are the interaction coefficients of the full design, errors included."""
    rng = np.random.default_rng(5)
    n = 600
    a, b, f, g = rng.integers(1, 7, n), rng.integers(2, 6, n), rng.choice(["x", "y", "z"], n), rng.choice(["p", "q"], n)
    y = 1 + a * (0.5 + (f == "y")) + 2 * (f == "z") * (g == "q") - 0.3 * a * b * (g == "p") + rng.normal(0, 0.5, n)
    rows = [(int(i), int(j), str(k), str(m), float(v)) for i, j, k, m, v in zip(a, b, f, g, y, strict=True)]
    rows += [(None, 2, "x", "p", 9.0), (1, 2, None, "p", 9.0), (1, 2, "x", None, 9.0), (1, 2, "x", "p", None)]
    df = spark.createDataFrame(rows, "a int, b int, f string, g string, y double")
    fit = lambda d: md.factor_fit(d, {"a": F.col("a"), "b": F.col("b")}, {"f": F.col("f"), "g": F.col("g")}, F.col("y"), "f")
    got = {(r.f, r.g, r.term): r for r in fit(df).collect()}
    assert len(got) == 3 * 2 * 4
    lines = np.column_stack([np.ones(n), a, b, a * b]).astype(float)
    names = ["intercept", "a", "b", "a:b"]
    blocks = [(k, m) for m in "pq" for k in "xyz"]
    # x is the base of each g; y and z enter as differences from it
    X = np.column_stack([lines * ((g == m) & ((f == k) | (k == "x")))[:, None] for k, m in blocks])
    beta, sse, *_ = np.linalg.lstsq(X, y, rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * sse[0] / (n - X.shape[1]))
    for c, (k, m) in enumerate(blocks):
        for i, t in enumerate(names):
            r = got[k, m, t]
            value, error = (r.estimate, r.std_error) if k == "x" else (r.difference, r.difference_error)
            assert abs(value - beta[4 * c + i]) < 2e-6 and abs(error - errors[4 * c + i]) < 2e-6
            assert (r.difference is None) == (k == "x") and r.n == ((f == k) & (g == m)).sum()


def test_factor_fit_names_aliased_terms(spark):
    rows = [(k, 3, "one", float(2 * k)) for k in range(1, 5)] + [(2, k, "two", float(k)) for k in range(1, 4)] + [(1, 1, "single", 5.0)]
    df = spark.createDataFrame(rows, "a int, b int, f string, y double")
    fit = lambda d: md.factor_fit(d, {"a": F.col("a"), "b": F.col("b")}, {"f": F.col("f")}, F.col("y"), "f")
    got = {(r.f, r.term): r.estimate for r in fit(df).collect()}
    assert got == {
        ("one", "intercept"): 0.0, ("one", "a"): 2.0, ("one", "b"): None, ("one", "a:b"): None,
        ("two", "intercept"): 0.0, ("two", "a"): None, ("two", "b"): 1.0, ("two", "a:b"): None,
        ("single", "intercept"): 5.0, ("single", "a"): None, ("single", "b"): None, ("single", "a:b"): None,
    }
    assert fit(df.limit(0)).collect() == []
    assert {r.std_error for r in fit(df.where("f = 'single'")).collect()} == {None}
