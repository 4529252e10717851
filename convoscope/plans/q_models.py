"""Model query keys over words per trial (and convention occurrence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.operators import chat
from convoscope.operators import models as md
from convoscope.plans import fixtures as fx
from convoscope.plans.q_conventions import occ_turn
from convoscope.plans.q_star import _STAR_SQL
from convoscope.plans.q_text import _MERGED_SQL, merged_stage_one
from convoscope.plans.registry import register
from convoscope.sources.tables import table

K_FOLDS = 5
NESTED_ROUNDS = 6
GRID_N = 6


def rep_df(spark, sf_dir):
    return chat.words_per_trial(merged_stage_one(spark, sf_dir))


_REP_SQL = """, rep AS (SELECT * FROM (SELECT dataset_id, condition_id, game_id, trial_num, rep_num, target, group_size, structure, option_size, stage_num,
   CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS total_num_words
 FROM mm WHERE role = 'describer' AND NOT coalesce(message_irrelevant, false) AND text IS NOT NULL
 GROUP BY dataset_id, condition_id, game_id, trial_num, rep_num, target, group_size, structure, option_size, stage_num)
 WHERE total_num_words IS NOT NULL)
"""


def _sql(body: str) -> str:
    head = fx.with_views("", "conditions_f", "trials_f", "messages_f").rstrip()
    return head + _STAR_SQL + _MERGED_SQL + _REP_SQL + body


def _terms_sql(model: str) -> list[str]:
    rep, trial = "CAST(rep_num AS DOUBLE)", "CAST(trial_num AS DOUBLE)"
    return {
        "linear": [rep, trial],
        "logarithmic": [f"ln({rep})", f"ln({trial})"],
        "quadratic": [rep, f"{rep} * {rep}", trial, f"{trial} * {trial}"],
    }[model]


def _sweep_sql(name: str, src: str, p: int, by: str = "") -> str:
    """CTEs that fit y on x0..x(p-1) of ``src`` by sweeping the centred cross-products once per term.
    The last one, ``name``, has n, means m_i and my, slopes b_i, sse, and the inverse as i_i_j."""
    var = [*(f"x{i}" for i in range(p)), "y"]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    first = ", ".join(f"covar_pop({var[i]}, {var[j]}) * count(*) AS a_{i}_{j}" for i, j in pairs)
    means = ", ".join(f"avg({v}) AS m{v}" for v in var)
    keep = key + "n, " + ", ".join(f"m{v}" for v in var)
    out = [f"{name}_s0 AS (SELECT {key}CAST(count(*) AS DOUBLE) AS n, {means}, {first} FROM {src}{group})"]
    at = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    for k in range(p):
        d = at(k, k)
        cells = []
        for i, j in pairs:
            if i == k and j == k:
                e = f"-1 / {d}"
            elif k in (i, j):
                e = f"{at(i, j)} / {d}"
            else:
                e = f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {d}"
            cells.append(f"{e} AS {at(i, j)}")
        out.append(f"{name}_s{k + 1} AS (SELECT {keep}, {', '.join(cells)} FROM {name}_s{k})")
    slopes = ", ".join(f"{at(i, p)} AS b{i}" for i in range(p))
    inverse = ", ".join(f"-{at(i, j)} AS i_{i}_{j}" for i in range(p) for j in range(i, p))
    icpt = "my - (" + " + ".join(f"{at(i, p)} * mx{i}" for i in range(p)) + ")"
    out.append(
        f"{name} AS (SELECT {keep}, {icpt} AS b, {slopes}, {inverse}, {at(p, p)} AS sse, {at(p, p)} / (n - {p + 1}) AS sigma2 FROM {name}_s{p})"
    )
    return ", " + ",\n ".join(out)


def _form_src(model: str, extra: str = "") -> str:
    cols = ", ".join(f"{t} AS x{i}" for i, t in enumerate(_terms_sql(model)))
    return f"(SELECT {extra}{cols}, CAST(total_num_words AS DOUBLE) AS y FROM rep)"


def _quad(p: int, x: list[str]) -> str:
    """x' inverse x, from the upper half of the inverse."""
    return " + ".join(f"{'' if i == j else '2 * '}i_{i}_{j} * {x[i]} * {x[j]}" for i in range(p) for j in range(i, p))


def _coef_sql(model: str, r2: bool) -> str:
    terms = md.FORMS[model]
    p = len(terms)
    name = model[:4]
    end = f", CAST(n AS BIGINT) AS n{', round(1 - sse / syy, 6) AS r2' if r2 else ''} FROM {name}, (SELECT covar_pop(y, y) * count(*) AS syy FROM {_form_src(model)})"
    means = [f"mx{i}" for i in range(p)]
    parts = [f"SELECT '{model}' AS model, 'intercept' AS term, round(b, 6) AS estimate, round(sqrt(sigma2 * (1 / n + {_quad(p, means)})), 6) AS std_error{end}"]
    parts += [f"SELECT '{model}', '{t}', round(b{i}, 6), round(sqrt(sigma2 * i_{i}_{i}), 6){end}" for i, t in enumerate(terms)]
    return _sweep_sql(name, _form_src(model), p) + "\n" + "\nUNION ALL ".join(parts)


def _trial_key() -> F.Column:
    return F.concat_ws("/", "dataset_id", "game_id", F.col("trial_num").cast("string"), F.col("rep_num").cast("string"))


def _moments(df) -> md.Moments:
    """Moments of the columns of all forms: one read."""
    columns = {**md.form_terms(), "total_num_words": F.col("total_num_words")}
    return md.Moments.of(columns, md.moment_table(df, columns).first())


def _fit(moments: md.Moments, model: str) -> md.Ols:
    return md.ols_of(moments.part([*md.FORMS[model], "total_num_words"]))


@register("form_lin_fit", _sql(_coef_sql("linear", True)), bench=True)
def q_form_lin_fit(spark, sf_dir):
    return md.coef_table(spark, _fit(_moments(rep_df(spark, sf_dir)), "linear"), "linear")


@register("form_log_fit", _sql(_coef_sql("logarithmic", True)))
def q_form_log_fit(spark, sf_dir):
    return md.coef_table(spark, _fit(_moments(rep_df(spark, sf_dir)), "logarithmic"), "logarithmic")


@register("form_quad_fit", _sql(_coef_sql("quadratic", False)))
def q_form_quad_fit(spark, sf_dir):
    return md.ols_table(spark, _fit(_moments(rep_df(spark, sf_dir)), "quadratic"), "quadratic")


_GRID_SQL = f""", grid AS (SELECT CAST(range + 1 AS INTEGER) AS rep_num, 6.0::DOUBLE + range * (60.0::DOUBLE / {GRID_N - 1}) AS trial_num FROM range(0, {GRID_N}))
"""


def _pred_sql(models) -> str:
    ctes, parts = "", []
    for model in models:
        p, name = len(md.FORMS[model]), model[:4]
        ctes += _sweep_sql(name, _form_src(model), p)
        x = [t.replace("rep_num", "g.rep_num").replace("trial_num", "g.trial_num") for t in _terms_sql(model)]
        mean = "(b + " + " + ".join(f"b{i} * {t}" for i, t in enumerate(x)) + ")"
        half = f"{md.Z95} * sqrt(sigma2 * (1 / n + {_quad(p, [f'({t} - mx{i})' for i, t in enumerate(x)])}))"
        parts.append(
            f"SELECT '{model}' AS model, g.rep_num, round(g.trial_num, 6) AS trial_num, round({mean}, 6) AS estimate, "
            f"round({mean} - {half}, 6) AS q2_5, round({mean} + {half}, 6) AS q97_5 FROM grid g, {name}"
        )
    return ctes + _GRID_SQL + "\nUNION ALL ".join(parts)


def _predictions(spark, sf_dir, models):
    moments, grid = _moments(rep_df(spark, sf_dir)), md.pred_grid(spark, GRID_N)
    parts = [md.ols_predict(_fit(moments, m), grid, {t: md.form_terms()[t] for t in md.FORMS[m]}, m) for m in models]
    return reduce(DataFrame.unionByName, parts)


@register("form_pred_grid", _sql(_pred_sql(md.FORMS)))
def q_form_pred_grid(spark, sf_dir):
    return _predictions(spark, sf_dir, md.FORMS)


@register("form_quad_pred_grid", _sql(_pred_sql(["quadratic"])))
def q_form_quad_pred_grid(spark, sf_dir):
    return _predictions(spark, sf_dir, ["quadratic"])


def _compare_sql(models) -> str:
    key = "dataset_id || '/' || game_id || '/' || CAST(trial_num AS VARCHAR) || '/' || CAST(rep_num AS VARCHAR)"
    fold = f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {K_FOLDS} AS INTEGER) AS fold, "
    ctes, parts = "", []
    for model in models:
        p, name = len(md.FORMS[model]), model[:4]
        ctes += f", {name}_d AS {_form_src(model, fold)},\n {name}_t AS (SELECT f.fold AS held, d.* FROM (SELECT DISTINCT fold FROM {name}_d) f JOIN {name}_d d ON d.fold <> f.fold)"
        ctes += _sweep_sql(name, f"{name}_t", p, "held")
        r = "(d.y - (c.b + " + " + ".join(f"c.b{i} * d.x{i}" for i in range(p)) + "))"
        parts.append(
            f"SELECT '{model}' AS model, d.fold, count(*) AS n_test, sqrt(avg({r} * {r})) AS rmse, "
            f"sum(-0.5 * ln(2 * pi() * c.sigma2) - {r} * {r} / (2 * c.sigma2)) AS log_density FROM {name}_d d JOIN {name} c ON c.held = d.fold GROUP BY d.fold"
        )
    ctes += ", cv AS (" + "\nUNION ALL ".join(parts) + ")"
    ctes += ", tot AS (SELECT model, sum(log_density) AS t, CAST(rank() OVER (ORDER BY sum(log_density) DESC) AS INTEGER) AS model_rank FROM cv GROUP BY model)"
    return (
        ctes + " SELECT model, fold, n_test, round(rmse, 6) AS rmse, round(log_density, 4) AS log_density, "
        "round(t, 4) AS model_log_density, model_rank FROM cv JOIN tot USING (model)"
    )


def _comparison(spark, sf_dir, models):
    columns = {**md.form_terms(), "total_num_words": F.col("total_num_words")}
    d = rep_df(spark, sf_dir).withColumn("trial_key", _trial_key())
    folds = md.fold_moments(d, columns, "trial_key", K_FOLDS)
    return md.compare_forms(spark, folds, {m: md.FORMS[m] for m in models}, "total_num_words")


@register("form_compare", _sql(_compare_sql(md.FORMS)))
def q_form_compare(spark, sf_dir):
    return _comparison(spark, sf_dir, md.FORMS)


@register("form_quad_compare", _sql(_compare_sql(["quadratic"])))
def q_form_quad_compare(spark, sf_dir):
    return _comparison(spark, sf_dir, ["quadratic"])


@register("nested_shrinkage")
def q_nested_shrinkage(spark, sf_dir):
    """Intercept and both slopes of every dataset, condition and game, shrunk level by level."""
    from convoscope.operators import nested

    levels = ["dataset_id", "condition_id", "game_id"]
    terms = {"rep_num": F.col("rep_num"), "trial_num": F.col("trial_num")}
    model = nested.fit(rep_df(spark, sf_dir), levels, terms, F.col("total_num_words"), rounds=NESTED_ROUNDS)
    rounded = [F.round(c, 6).alias(c) for c in model.terms]
    return nested.coefficients(model).select("level", *levels, "n", *rounded)


@register(
    "group_shrinkage",
    _sql(
        """, g AS (SELECT * FROM (SELECT dataset_id, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
   regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
   FROM (SELECT dataset_id, CAST(rep_num AS DOUBLE) AS x, CAST(total_num_words AS DOUBLE) AS y FROM rep) GROUP BY dataset_id)),
 gv AS (SELECT *, CASE WHEN n > 2 AND sxx > 0 THEN greatest(((syy - slope * sxy) / (n - 2)) / sxx, 0.0) END AS slope_var FROM g),
 gp AS (SELECT * FROM gv WHERE slope_var > 0),
 pool AS (SELECT sum(slope / slope_var) / sum(1 / slope_var) AS pooled_slope, coalesce(greatest(var_samp(slope) - avg(slope_var), 0.0), 0.0) AS tau2 FROM gp),
 w AS (SELECT gv.*, pool.pooled_slope, pool.tau2, CASE WHEN slope_var > 0 THEN pool.tau2 / (pool.tau2 + gv.slope_var) WHEN slope_var = 0 THEN 1.0 ELSE 0.0 END AS weight FROM gv JOIN pool ON true)
SELECT dataset_id, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(slope_var, 6) AS slope_var,
  round(pooled_slope, 6) AS pooled_slope, round(tau2, 6) AS tau2, round(weight, 6) AS weight,
  round(pooled_slope + CASE WHEN weight > 0 THEN weight * (slope - pooled_slope) ELSE 0.0 END, 6) AS shrunk_slope FROM w"""
    ),
)
def q_group_shrinkage(spark, sf_dir):
    return md.group_shrinkage(rep_df(spark, sf_dir), "dataset_id", "rep_num", "total_num_words")


@register("form_interactions")
def q_form_interactions(spark, sf_dir):
    """log(response) ~ round * size * structure over ``lineitem``, which has rows in every cell:
    price for words, line number for round, quantity for size, return flag for structure."""
    d = table(spark, sf_dir, "lineitem")
    flags = [r[0] for r in d.select("l_returnflag").distinct().orderBy("l_returnflag").limit(50).collect()]
    terms = md.interaction_terms(
        {"round": F.col("l_linenumber"), "size": F.col("l_quantity")}, {"structure": (F.col("l_returnflag"), flags)}
    )
    return md.ols_table(spark, md.ols(d, terms, F.ln("l_extendedprice")), "interactions")


def _factor_sql(names: list[str], keys: list[str], contrast: str) -> str:
    """CTEs and query over ``src`` (keys, x0.., y): per cell a sweep that passes over aliased terms."""
    p, key = len(names), ", ".join(keys)
    var = [*(f"x{i}" for i in range(p)), "y"]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    at = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    means = ", ".join(f"avg({v}) AS m{i}" for i, v in enumerate(var))
    first = ", ".join(f"covar_pop({var[i]}, {var[j]}) * count(*) AS {at(i, j)}" for i, j in pairs)
    ctes = [f"w0 AS (SELECT {key}, count(*) AS n, {means}, {first}, {', '.join(f'var_pop({v}) * count(*) AS s{i}' for i, v in enumerate(var[:p]))} FROM src GROUP BY {key})"]
    keep = f"{key}, n, " + ", ".join([*(f"m{i}" for i in range(p + 1)), *(f"s{i}" for i in range(p))])
    for k in range(p):
        clear, cells = f"{at(k, k)} > {md.ALIASED} * s{k}", []
        for i, j in pairs:
            if i == j == k:
                e = f"-1 / {at(k, k)}"
            elif k in (i, j):
                e = f"{at(i, j)} / {at(k, k)}"
            else:
                e = f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {at(k, k)}"
            cells.append(f"CASE WHEN {clear} THEN {e} ELSE {at(i, j)} END AS {at(i, j)}")
        flags = ", ".join([*(f"ok{i}" for i in range(k)), f"{clear} AS ok{k}"])
        ctes.append(f"w{k + 1} AS (SELECT {keep}, {flags}, {', '.join(cells)} FROM w{k})")
    lean = " + ".join(f"CASE WHEN ok{i} THEN {at(i, p)} * m{i} ELSE 0 END" for i in range(p))
    spread = " + ".join(f"CASE WHEN ok{i} AND ok{j} THEN -{at(i, j)} * m{i} * m{j} ELSE 0 END" for i in range(p) for j in range(p))
    used = " + ".join(f"CAST(ok{i} AS INTEGER)" for i in range(p))
    parts = [f"SELECT {key}, n, 'intercept' AS term, m{p} - ({lean}) AS b, 1 / n + {spread} AS v FROM w{p}"]
    parts += [f"SELECT {key}, n, '{t}', CASE WHEN ok{i} THEN {at(i, p)} END, CASE WHEN ok{i} THEN -{at(i, i)} END FROM w{p}" for i, t in enumerate(names)]
    ctes.append(f"shared AS (SELECT CASE WHEN sum(n - 1 - ({used})) > 0 THEN sum(greatest({at(p, p)}, 0)) / sum(n - 1 - ({used})) END AS sigma2 FROM w{p})")
    ctes.append("long AS (" + " UNION ALL ".join(parts) + ")")
    fixed = ", ".join(["term", *(k for k in keys if k != contrast)])
    win = f"OVER (PARTITION BY {fixed} ORDER BY {contrast})"
    ctes.append(f"based AS (SELECT *, first_value(b) {win} AS b0, first_value(v) {win} AS v0, first_value({contrast}) {win} <> {contrast} AS other FROM long)")
    return ", " + ",\n ".join(ctes) + f"""
SELECT {key}, term, n, round(b, 6) AS estimate, round(sqrt(sigma2 * v), 6) AS std_error,
  CASE WHEN other THEN round(b - b0, 6) END AS difference, CASE WHEN other THEN round(sqrt(sigma2 * (v + v0)), 6) END AS difference_error
FROM based, shared"""


@register(
    "form_target_interactions",
    _sql(
        """, src AS (SELECT target, structure, rep_num::DOUBLE AS x0, group_size::DOUBLE AS x1, rep_num::DOUBLE * group_size AS x2, ln(total_num_words) AS y
 FROM rep WHERE target IS NOT NULL AND structure IS NOT NULL AND rep_num IS NOT NULL AND group_size IS NOT NULL)"""
        + _factor_sql(["rep_num", "group_size", "rep_num:group_size"], ["target", "structure"], "target")
    ),
)
def q_form_target_interactions(spark, sf_dir):
    """log(words) ~ round * target * size * structure, per trial."""
    numeric = {"rep_num": F.col("rep_num"), "group_size": F.col("group_size")}
    factors = {"target": F.col("target"), "structure": F.col("structure")}
    return md.factor_fit(rep_df(spark, sf_dir), numeric, factors, F.ln("total_num_words"), contrast="target")


@register("occurrence_logit")
def q_occurrence_logit(spark, sf_dir):
    from convoscope.operators.conventions import with_progress

    occ = with_progress(occ_turn(spark, sf_dir).where(F.col("role") == "describer"))
    occ = occ.withColumn("grp", F.concat(F.col("structure"), F.col("group_size").cast("string")))
    return md.logit_by_group(occ, "grp", "frac", "fuzzy_regex")


@register("occurrence_logit_all")
def q_occurrence_logit_all(spark, sf_dir):
    """Exact and fuzzy flag, by condition and by target, in one set of Newton rounds."""
    from convoscope.operators.conventions import with_progress

    occ = with_progress(occ_turn(spark, sf_dir).where(F.col("role") == "describer"))
    groups = {"condition": F.concat(F.col("structure"), F.col("group_size").cast("string")), "target": F.col("target")}
    return md.logit_by_groups(occ, groups, "frac", ["base_regex", "fuzzy_regex"])
