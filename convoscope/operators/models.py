"""Regression summaries of message length over rounds.

Least squares comes from one pass of centred, mergeable moments
(``operators/moments.py``): a fit over any number of rows moves a handful of
numbers, and one read serves every form of the curve, every fold of a comparison and
every prediction.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.operators.joins import attach_row, broadcast_if_small, join_null_safe
from convoscope.operators.moments import Moments, log_density, merge_all, moment_table

Z95 = 1.959963984540054


def coef_table(spark, fit: Ols, model: str) -> DataFrame:
    """Long table (model, term, estimate, std_error, n, r2), rounded."""
    rows = [
        (model, t, float(round(b, 6)), float(round(math.sqrt(v), 6)), fit.n, float(round(fit.r2, 6)))
        for t, b, v in zip(fit.terms, fit.beta, np.diag(fit.cov), strict=True)
    ]
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_error double, n long, r2 double")


def pred_grid(spark, n: int = 6, trial_from: float = 6.0, trial_to: float = 66.0) -> DataFrame:
    """rep 1..n with trial numbers evenly spaced from ``trial_from`` to ``trial_to``."""
    step = (trial_to - trial_from) / (n - 1)
    g = spark.range(n).select((F.col("id") + 1).cast("int").alias("rep_num"))
    return g.withColumn("trial_num", F.lit(trial_from) + (F.col("rep_num") - 1) * F.lit(step))


def fold_of(key, k: int = 5) -> F.Column:
    """Fold of a row by a hash of its own key, which no model uses as a predictor."""
    c = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")


def group_shrinkage(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Per-group slope of y on x, shrunk toward the precision-weighted pooled
    slope (two-level normal model, method-of-moments between-group variance):
    w_g = tau2 / (tau2 + v_g), shrunk = pooled + w_g (slope_g - pooled).

    Every group stays: one whose slope can't be estimated (two rows or fewer, or
    a constant x) has weight 0 and takes the pooled slope; one that its line
    fits exactly keeps its own, but doesn't enter the pooled moments."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.groupBy(group).agg(
        F.regr_count(Y, X).alias("n"),
        F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"),
        F.regr_sxx(Y, X).alias("sxx"),
        F.regr_syy(Y, X).alias("syy"),
        F.regr_sxy(Y, X).alias("sxy"),
    )
    v = ((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)) / F.col("sxx")
    g = g.withColumn("slope_var", F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.greatest(v, F.lit(0.0))))
    # pooled slope and between-group variance: a one-row aggregate over the
    # per-group table, attached as a scalar subquery
    pool = g.where(F.col("slope_var") > 0).agg(
        (F.sum(F.col("slope") / F.col("slope_var")) / F.sum(1 / F.col("slope_var"))).alias("pooled_slope"),
        F.coalesce(F.greatest(F.var_samp("slope") - F.avg("slope_var"), F.lit(0.0)), F.lit(0.0)).alias("tau2"),
    )
    g = attach_row(g, pool)
    wt = F.when(F.col("slope_var") > 0, F.col("tau2") / (F.col("tau2") + F.col("slope_var"))).when(F.col("slope_var") == 0, 1.0).otherwise(0.0)
    own = F.when(wt > 0, wt * (F.col("slope") - F.col("pooled_slope"))).otherwise(0.0)
    g = g.withColumn("weight", wt).withColumn("shrunk_slope", F.col("pooled_slope") + own)
    return g.select(
        group, "n",
        *[F.round(c, 6).alias(c) for c in ["slope", "intercept", "slope_var", "pooled_slope", "tau2", "weight", "shrunk_slope"]],
    )


# --- logistic fits per group ----------------------------------------------------------

#: Newton rounds at most; a group stops by itself once its step is below LOGIT_STEP.
LOGIT_ROUNDS, LOGIT_STEP = 30, 1e-10


def logit_by_groups(df: DataFrame, groups: Mapping[str, F.Column], x: str, flags: Sequence[str]) -> DataFrame:
    """Logistic fits of 0/1 flags on x, for every flag and every value of every grouping at once.

    Rows: flag, grouping (the name in ``groups``), grp (its value; NULL is a group of its own),
    intercept, slope, n, converged.  A row without x or without the flag takes no part.

    The rows are read once and collapsed to (flag, grouping, grp, x, trials, hits).  A Newton round is
    one aggregate over that table for all fits together: each group's gradient and information, five
    numbers, and its next coefficients from them.  ``converged`` is false where the likelihood has no
    maximum (all hits or none, or a step function of x) or x is constant; such a group stays where its
    last regular step left it."""
    long = df.select(
        F.col(x).cast("double").alias("x"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("double").alias("y")) for f in flags])).alias("f"),
        F.array(*[F.struct(F.lit(k).alias("grouping"), c.cast("string").alias("grp")) for k, c in groups.items()]).alias("g"),
    ).where("x IS NOT NULL AND f.y IS NOT NULL")
    keys = ["flag", "grouping", "grp"]
    cells = long.select("f.flag", F.inline("g"), "x", "f.y").groupBy(*keys, "x")
    cells = cells.agg(F.count(F.lit(1)).cast("double").alias("trials"), F.sum("y").alias("hits")).checkpoint()
    start = cells.groupBy(*keys).agg(F.sum("trials").cast("long").alias("n"))
    state = start.select(*keys, "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit("open").alias("status")).checkpoint()
    for _ in range(LOGIT_ROUNDS):
        going = state.where("status = 'open'")
        if going.isEmpty():
            break
        mu = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        # one row a group, written: broadcast after a count
        rows = join_null_safe(cells, broadcast_if_small(going), keys).withColumn("mu", mu)
        w = F.col("trials") * F.col("mu") * (1 - F.col("mu"))
        off = F.col("hits") - F.col("trials") * F.col("mu")
        sums = rows.groupBy(*keys, "n", "a", "b").agg(
            F.sum(off).alias("g0"), F.sum(off * F.col("x")).alias("g1"),
            F.sum(w).alias("h0"), F.sum(w * F.col("x")).alias("h1"), F.sum(w * F.col("x") * F.col("x")).alias("h2"),
        )
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        regular = (F.col("h0") > 1e-12) & (det > 1e-12 * F.col("h0") * F.col("h2"))
        da = F.when(regular, (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).otherwise(0.0)
        db = F.when(regular, (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).otherwise(0.0)
        near = F.greatest(F.abs(da), F.abs(db)) < LOGIT_STEP
        status = F.when(~regular, "none").when(near, "done").otherwise("open")
        moved = sums.select(*keys, "n", (F.col("a") + da).alias("a"), (F.col("b") + db).alias("b"), status.alias("status"))
        state = state.where("status <> 'open'").unionByName(moved).checkpoint()
    return state.select(
        *keys, F.round("a", 6).alias("intercept"), F.round("b", 6).alias("slope"), "n", (F.col("status") == "done").alias("converged")
    )


def logit_by_group(df: DataFrame, group: str, x: str, flag: str) -> DataFrame:
    """``logit_by_groups`` for one flag and one grouping: grp, intercept, slope, n, converged."""
    return logit_by_groups(df, {group: F.col(group)}, x, [flag]).drop("flag", "grouping")


def fit_or_load(estimator, data: DataFrame, path: str, model_cls):
    """Reuse a fitted model saved at ``path``; otherwise fit and save it there
    (the path should be on shared storage)."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return model_cls.load(path)
    except (AnalysisException, Py4JJavaError, OSError):
        model = estimator.fit(data)
        model.write().overwrite().save(path)
        return model


# --- least squares for any number of terms -------------------------------------------


@dataclass
class Ols:
    terms: list[str]  # intercept first
    beta: np.ndarray
    cov: np.ndarray  # of beta
    sigma2: float
    n: int
    r2: float


def _solve(names: Sequence[str], n: float, means: np.ndarray, cross: np.ndarray) -> Ols:
    """Coefficients from centred cross-products of terms and response (the last)."""
    p = len(names)
    sxx, sxy, syy = cross[:p, :p], cross[:p, p], cross[p, p]
    scale = np.sqrt(np.diag(sxx))
    if n <= p + 1 or (scale <= 0).any() or np.linalg.cond(sxx / np.outer(scale, scale)) > 1e12:
        raise ValueError(f"the terms {list(names)} are not of full rank in {int(n)} rows")
    slope = np.linalg.solve(sxx, sxy)
    sigma2 = float((syy - slope @ sxy) / (n - p - 1))
    inv = np.linalg.inv(sxx)
    mx = means[:p]
    cov = np.zeros((p + 1, p + 1))
    cov[1:, 1:] = inv
    cov[0, 1:] = cov[1:, 0] = -mx @ inv
    cov[0, 0] = 1 / n + mx @ inv @ mx
    beta = np.concatenate([[means[p] - slope @ mx], slope])
    r2 = 1 - sigma2 * (n - p - 1) / float(syy) if syy > 0 else math.nan
    return Ols(["intercept", *names], beta, sigma2 * cov, sigma2, int(n), r2)


def ols(df: DataFrame, terms: Mapping[str, F.Column], y: F.Column) -> Ols:
    """Least squares of y on the terms from centred moments: one read, one row to
    the driver.  Raises if there are no rows or the terms are not of full rank."""
    columns = {**terms, "_y": y}
    return ols_of(Moments.of(columns, moment_table(df, columns).first()))


def ols_of(m: Moments) -> Ols:
    """Least squares of the last column on the others."""
    if not m.n:
        raise ValueError("no rows to fit")
    return _solve(m.names[:-1], m.n, m.mean, m.cross)


def ols_table(spark, fit: Ols, model: str) -> DataFrame:
    rows = [
        (model, t, float(round(b, 6)), float(round(math.sqrt(v), 6)), fit.n)
        for t, b, v in zip(fit.terms, fit.beta, np.diag(fit.cov), strict=True)
    ]
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_error double, n long")


#: The forms of the curve over rounds and their terms, after the intercept.
FORMS = {
    "linear": ["rep_num", "trial_num"],
    "logarithmic": ["log_rep", "log_trial"],
    "quadratic": ["rep_num", "rep_num2", "trial_num", "trial_num2"],
}


def form_terms() -> dict[str, F.Column]:
    """The columns of all forms."""
    rep, trial = F.col("rep_num").cast("double"), F.col("trial_num").cast("double")
    return {
        "rep_num": rep, "trial_num": trial, "log_rep": F.ln(rep), "log_trial": F.ln(trial),
        "rep_num2": rep * rep, "trial_num2": trial * trial,
    }


def quadratic_terms() -> dict[str, F.Column]:
    return {t: form_terms()[t] for t in FORMS["quadratic"]}


def ols_predict(fit: Ols, grid: DataFrame, terms: Mapping[str, F.Column], model: str) -> DataFrame:
    """Fitted mean with a 95% interval on the grid; the fit travels as literals."""
    x = [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    mean = sum((F.lit(float(b)) * c for b, c in zip(fit.beta, x, strict=True)), F.lit(0.0))
    var = sum((F.lit(float(fit.cov[i, j])) * a * b for i, a in enumerate(x) for j, b in enumerate(x)), F.lit(0.0))
    half = F.lit(Z95) * F.sqrt(F.greatest(var, F.lit(0.0)))
    return grid.select(
        F.lit(model).alias("model"), "rep_num", F.round("trial_num", 6).alias("trial_num"),
        F.round(mean, 6).alias("estimate"), F.round(mean - half, 6).alias("q2_5"), F.round(mean + half, 6).alias("q97_5"),
    )


def fold_moments(df: DataFrame, columns: Mapping[str, F.Column], fold_key: str, k: int = 5) -> dict[int, Moments]:
    """Moments of every fold: all that fits, comparisons and predictions of any form need, from one read."""
    rows = moment_table(df, columns, [fold_of(fold_key, k).alias("fold")]).collect()  # k rows at most
    return {r["fold"]: Moments.of(columns, r) for r in rows}


def compare_forms(spark, folds: Mapping[int, Moments], forms: Mapping[str, Sequence[str]], y: str) -> DataFrame:
    """k-fold comparison: model, fold, n_test, rmse, log_density, and per model its summed
    log density and rank (1: best).  Each fold's rows are predicted by the fit on the others;
    both come from moments, so no row is read again."""
    out = []
    for model, terms in forms.items():
        names = [*terms, y]
        for fold, held in sorted(folds.items()):
            others = [m for f, m in folds.items() if f != fold]
            if not others:
                raise ValueError("a comparison needs rows in two folds at least")
            fit = ols_of(merge_all(others).part(names))
            sse = held.part(names).squared_error(fit.beta)
            out.append((model, fold, int(held.n), math.sqrt(sse / held.n), log_density(held.n, sse, fit.sigma2)))
    total = {m: sum(r[4] for r in out if r[0] == m) for m in forms}
    rank = {m: 1 + sum(t > total[m] for t in total.values()) for m in forms}
    rows = [(m, f, n, round(e, 6), round(d, 4), round(total[m], 4), rank[m]) for m, f, n, e, d in out]
    return spark.createDataFrame(
        rows, "model string, fold int, n_test long, rmse double, log_density double, model_log_density double, model_rank int"
    )


def interaction_terms(numeric: Mapping[str, F.Column], factors: Mapping[str, tuple[F.Column, Sequence]]) -> dict[str, F.Column]:
    """Terms of ``a * b * ...``: each factor as contrasts against its first level, and all products."""
    groups = [{k: c.cast("double")} for k, c in numeric.items()]
    for name, (col, levels) in factors.items():
        groups.append({f"{name}={v}": (col == v).cast("double") for v in levels[1:]})
    out: dict[str, F.Column] = {}
    for group in groups:
        out |= {**group, **{f"{a}:{b}": x * y for a, x in out.items() for b, y in group.items()}}
    return out


#: A term whose spread, given the terms before it, is below this share of its own adds nothing: it is aliased.
ALIASED = 1e-9


def factor_fit(df: DataFrame, numeric: Mapping[str, F.Column], factors: Mapping[str, F.Column], y: F.Column, contrast: str) -> DataFrame:
    """Least squares of y on ``a * b * ... * factor * factor ...``, for factors of any number of levels.

    With every product of the factors in the model, each cell (combination of levels that occurs) has
    coefficients of its own; only the error variance is shared.  So one grouped aggregate of centred
    moments per cell replaces the wide design, and nothing but cells leaves the scan.  Rows: the factors,
    term (``intercept``, the numeric names, their products as ``a:b``), n (rows of the cell), estimate,
    std_error, difference and difference_error: the estimate less that of the first level of ``contrast``
    in the same levels of the other factors, which is the model's interaction coefficient.

    A term that the cell's rows can't tell from those before it is aliased: NULL estimate, and no
    difference.  The first level's own difference is NULL.  Without a degree of freedom left over all
    cells the errors are NULL.  Rows with a NULL in any term, factor or y are left out.
    """
    terms = interaction_terms(numeric, {})
    p = len(terms)
    named = df.select(*[c.alias(k) for k, c in factors.items()], *[c.alias(f"_t{i}") for i, c in enumerate([*terms.values(), y])])
    columns = {f"_t{i}": F.col(f"_t{i}") for i in range(p + 1)}
    found = moment_table(named.dropna(subset=list(factors)), columns, list(factors)).checkpoint()  # one row a cell
    at = lambda i, j: F.col(f"c_{min(i, j)}_{max(i, j)}")
    cells = found
    for k in range(p):
        clear = F.col(f"c_{k}_{k}") > F.lit(ALIASED) * F.col(f"s{k}")
        if k == 0:
            cells = cells.withColumns({f"s{i}": F.col(f"c_{i}_{i}") for i in range(p)})
        cells = cells.withColumn(f"ok{k}", clear)
        swept = {}
        for i in range(p + 1):
            for j in range(i, p + 1):
                if i == j == k:
                    e = -1 / at(k, k)
                elif k in (i, j):
                    e = at(i, j) / at(k, k)
                else:
                    e = at(i, j) - at(i, k) * at(k, j) / at(k, k)
                swept[f"c_{i}_{j}"] = F.when(F.col(f"ok{k}"), e).otherwise(at(i, j))
        cells = cells.withColumns(swept)
    none = F.lit(0.0)
    ok = [F.col(f"ok{i}") for i in range(p)]
    lean = sum((F.when(ok[i], at(i, p) * F.col(f"m{i}")).otherwise(none) for i in range(p)), none)
    spread = sum((F.when(ok[i] & ok[j], -at(i, j) * F.col(f"m{i}") * F.col(f"m{j}")).otherwise(none) for i in range(p) for j in range(p)), none)
    rows = [F.struct(F.lit("intercept").alias("term"), (F.col(f"m{p}") - lean).alias("b"), (1 / F.col("n") + spread).alias("v"))]
    rows += [F.struct(F.lit(t).alias("term"), F.when(ok[i], at(i, p)).alias("b"), F.when(ok[i], -at(i, i)).alias("v")) for i, t in enumerate(terms)]
    used = sum((o.cast("long") for o in ok), F.lit(1).cast("long"))
    cells = cells.select(*factors, "n", F.array(*rows).alias("rows"), F.greatest(at(p, p), none).alias("sse"), (F.col("n") - used).alias("free"))
    cells = cells.checkpoint()
    shared = cells.agg(F.when(F.sum("free") > 0, F.sum("sse") / F.sum("free")).alias("sigma2"))
    fixed = [k for k in factors if k != contrast]
    first = cells.groupBy(*fixed).agg(F.min_by("rows", contrast).alias("base"), F.min(contrast).alias("base_level"))
    both = join_null_safe(cells, first, fixed) if fixed else attach_row(cells, first)
    both = attach_row(both, shared).select("*", F.posexplode("rows").alias("place", "r")).withColumn("z", F.element_at("base", F.col("place") + 1))
    other = F.col(contrast) != F.col("base_level")
    return both.select(
        *factors, "r.term", "n",
        F.round("r.b", 6).alias("estimate"),
        F.round(F.sqrt(F.col("sigma2") * F.col("r.v")), 6).alias("std_error"),
        F.when(other, F.round(F.col("r.b") - F.col("z.b"), 6)).alias("difference"),
        F.when(other, F.round(F.sqrt(F.col("sigma2") * (F.col("r.v") + F.col("z.v"))), 6)).alias("difference_error"),
    )
