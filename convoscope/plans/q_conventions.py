"""Convention-origin query keys over ``rounds_f`` / ``to_next_f``."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions import lexicon as lx
from convoscope.operators import conventions as cv
from convoscope.plans import fixtures as fx
from convoscope.plans.registry import register
from convoscope.plans.sqlparts import clean_sql, fuzzy_sql, in_list

EXCLUDED = ("p1",)
LAST_REP, LAST_BY_PAPER, LAST_BY_STRUCTURE = 6, {"p3": 5}, {"network-swap": 12}

G5 = ["game_id", "target", "paper_id", "structure", "group_size"]


def _ns(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


_LAST_SQL = " ".join(
    [f"WHEN paper_id = '{k}' THEN {n}" for k, n in LAST_BY_PAPER.items()]
    + [f"WHEN structure = '{k}' THEN {n}" for k, n in LAST_BY_STRUCTURE.items()]
)
_BASE_SQL = f""", base AS (SELECT game_id, paper_id, target, structure, group_size, stage_num, rep_num, trial_num, message_number, player_num, role,
   coalesce(text, '') AS text, CASE {_LAST_SQL} ELSE {LAST_REP} END AS last_rep FROM rounds_f WHERE paper_id NOT IN ({in_list(EXCLUDED)}) AND player_num IS NOT NULL),
 conv AS (SELECT * FROM (SELECT game_id, target, paper_id, structure, group_size, player_num AS conv_desc,
   {clean_sql("string_agg(text, ' ' ORDER BY message_number)")} AS convention
   FROM base WHERE role = 'describer' AND rep_num = last_rep GROUP BY game_id, target, rep_num, paper_id, structure, group_size, player_num) WHERE convention <> ''),
 om AS (SELECT m.*, c.conv_desc, c.convention, c.conv_desc = m.player_num AS same FROM (SELECT game_id, target, stage_num, trial_num, rep_num, message_number, {clean_sql('text')} AS text, role, player_num, structure, paper_id, group_size FROM base) m
   JOIN conv c ON {_ns('m', 'c', G5)}),
 occ_msg AS (SELECT *, CAST(contains(text, convention) AS INTEGER) AS base_regex, CAST({fuzzy_sql('convention', 'text')} AS INTEGER) AS fuzzy_regex FROM om),
 tt AS (SELECT game_id, player_num, target, stage_num, rep_num, trial_num, paper_id, role, structure, group_size,
   {clean_sql("string_agg(text, ' ' ORDER BY message_number)")} AS text FROM base
   GROUP BY game_id, player_num, target, stage_num, rep_num, trial_num, paper_id, role, structure, group_size),
 ot AS (SELECT t.*, c.conv_desc, c.convention, c.conv_desc = t.player_num AS same FROM tt t JOIN conv c ON {_ns('t', 'c', G5)}),
 occ AS (SELECT *, CAST(contains(text, convention) AS INTEGER) AS base_regex, CAST({fuzzy_sql('convention', 'text')} AS INTEGER) AS fuzzy_regex FROM ot)
"""


def _earliest_sql(name: str, flag: str, describer_only: bool) -> str:
    role = "role = 'describer' AND " if describer_only else ""
    return f""", {name} AS (SELECT * EXCLUDE (rk) FROM (SELECT *, rank() OVER (PARTITION BY {', '.join(G5)} ORDER BY rep_num) AS rk
   FROM occ WHERE {role}{flag} = 1) WHERE rk = 1)
"""


_EARLIEST_SQL = (
    _earliest_sql("e_desc_fuzzy", "fuzzy_regex", True)
    + _earliest_sql("e_desc_base", "base_regex", True)
    + _earliest_sql("e_any_fuzzy", "fuzzy_regex", False)
    + _earliest_sql("e_any_base", "base_regex", False)
)


def _sql(body: str, *views: str) -> str:
    return fx.with_views("", "rounds_f", *views).rstrip() + _BASE_SQL + _EARLIEST_SQL + body


def _base(spark, sf_dir):
    return cv.base_messages(fx.rounds_f(spark, sf_dir), EXCLUDED, LAST_REP, LAST_BY_PAPER, LAST_BY_STRUCTURE)


def _conv(spark, sf_dir):
    return cv.conventions(_base(spark, sf_dir))


def occ_turn(spark, sf_dir, role=None):
    """The per-turn occurrence table, written once to the checkpoint folder:
    every consumer (earliest rows, survival, progress, status) reads it from
    two or more plan branches, and the matching behind it is the expensive
    part; materialised, it also survives lost executors."""
    return cv.occurrence_per_turn(_base(spark, sf_dir), _conv(spark, sf_dir), role=role).checkpoint()


def occ_exact(spark, sf_dir, role=None):
    """Per turn with the exact flag only: built-in expressions, nothing written."""
    return cv.occurrence_per_turn(_base(spark, sf_dir), _conv(spark, sf_dir), fuzzy=False, role=role)


@register("conv_end", _sql("SELECT * FROM conv"))
def q_conv_end(spark, sf_dir):
    return _conv(spark, sf_dir)


@register("conv_occurrence_msg", _sql("SELECT * FROM occ_msg"))
def q_conv_occurrence_msg(spark, sf_dir):
    return cv.occurrence_per_message(_base(spark, sf_dir), _conv(spark, sf_dir))


@register("conv_occurrence", _sql("SELECT * FROM occ"), bench=True)
def q_conv_occurrence(spark, sf_dir):
    return cv.occurrence_per_turn(_base(spark, sf_dir), _conv(spark, sf_dir))


@register("earliest_describer_fuzzy", _sql("SELECT * FROM e_desc_fuzzy"))
def q_earliest_describer_fuzzy(spark, sf_dir):
    return cv.earliest(occ_turn(spark, sf_dir, "describer"), "fuzzy_regex", True)


@register("earliest_describer_base", _sql("SELECT * EXCLUDE (fuzzy_regex) FROM e_desc_base"))
def q_earliest_describer_base(spark, sf_dir):
    return cv.earliest(occ_exact(spark, sf_dir, "describer"), "base_regex", True)


@register("earliest_any_fuzzy", _sql("SELECT * FROM e_any_fuzzy"))
def q_earliest_any_fuzzy(spark, sf_dir):
    return cv.earliest(occ_turn(spark, sf_dir), "fuzzy_regex", False)


@register("earliest_any_base", _sql("SELECT * EXCLUDE (fuzzy_regex) FROM e_any_base"))
def q_earliest_any_base(spark, sf_dir):
    return cv.earliest(occ_exact(spark, sf_dir), "base_regex", False)


@register(
    "survival_locf",
    _sql(
        f"""SELECT *, last_value(fuzzy_regex IGNORE NULLS) OVER (PARTITION BY {', '.join(G5)} ORDER BY rep_num, player_num, conv_desc
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS occurred FROM occ WHERE role = 'describer'"""
    ),
)
def q_survival_locf(spark, sf_dir):
    return cv.survival_locf(occ_turn(spark, sf_dir, "describer"))


@register(
    "survival_ever",
    _sql(
        f"""SELECT *, CASE WHEN max(fuzzy_regex) OVER (PARTITION BY {', '.join(G5)} ORDER BY rep_num
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 1 ELSE 0 END AS occurred_by FROM occ WHERE role = 'describer'"""
    ),
)
def q_survival_ever(spark, sf_dir):
    return cv.survival_ever(occ_turn(spark, sf_dir, "describer"))


def _share_sql(src: str, cte: str) -> str:
    return f"""SELECT '{src}' AS source, structure, group_size, first, n, round(n / sum(n) OVER (PARTITION BY structure, group_size), 6) AS share
FROM (SELECT structure, group_size, CASE WHEN rep_num > 6 THEN '7+' ELSE CAST(rep_num AS VARCHAR) END AS first, count(*) AS n FROM {cte} GROUP BY ALL)"""


@register(
    "first_share",
    _sql(
        _share_sql("any_base", "e_any_base")
        + "\nUNION ALL "
        + _share_sql("any_fuzzy", "e_any_fuzzy")
        + "\nUNION ALL "
        + _share_sql("describer_fuzzy", "e_desc_fuzzy")
    ),
)
def q_first_share(spark, sf_dir):
    # the three earliest-round variants read the same (checkpointed) table
    occ = occ_turn(spark, sf_dir)
    parts = [
        ("any_base", cv.earliest(occ, "base_regex", False)),
        ("any_fuzzy", cv.earliest(occ, "fuzzy_regex", False)),
        ("describer_fuzzy", cv.earliest(occ, "fuzzy_regex", True)),
    ]
    out = None
    for name, e in parts:
        s = cv.first_share(e).withColumn("source", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


_PROGRESS_SQL = """, dp AS (SELECT *, rep_num / max(rep_num) OVER (PARTITION BY structure, group_size) AS frac FROM occ WHERE role = 'describer')
"""


@register(
    "occurrence_mean_se",
    _sql(
        _PROGRESS_SQL
        + """SELECT structure, group_size, structure || CAST(group_size AS VARCHAR) AS grp, round(frac, 6) AS frac, count(*) AS n,
  round(avg(base_regex), 6) AS mean_base, round(stddev_samp(base_regex) / sqrt(count(*)), 6) AS se_base,
  round(avg(fuzzy_regex), 6) AS mean_fuzzy, round(stddev_samp(fuzzy_regex) / sqrt(count(*)), 6) AS se_fuzzy
FROM dp GROUP BY structure, group_size, frac"""
    ),
)
def q_occurrence_mean_se(spark, sf_dir):
    return cv.occurrence_mean_se(occ_turn(spark, sf_dir, "describer"))


@register(
    "occurrence_mean_game",
    _sql(
        _PROGRESS_SQL
        + """SELECT structure, group_size, structure || CAST(group_size AS VARCHAR) AS grp, game_id, round(frac, 6) AS frac, count(*) AS n,
  round(avg(base_regex), 6) AS mean_base, round(stddev_samp(base_regex) / sqrt(count(*)), 6) AS se_base,
  round(avg(fuzzy_regex), 6) AS mean_fuzzy, round(stddev_samp(fuzzy_regex) / sqrt(count(*)), 6) AS se_fuzzy
FROM dp GROUP BY structure, group_size, game_id, frac"""
    ),
)
def q_occurrence_mean_game(spark, sf_dir):
    return cv.occurrence_mean_se(occ_turn(spark, sf_dir, "describer"), by=["game_id"])


@register(
    "occurrence_by_target",
    _sql(
        _PROGRESS_SQL
        + f"""SELECT target, round(frac, 6) AS frac, count(*) AS n, round(avg(fuzzy_regex), 6) AS mean_fuzzy
FROM dp WHERE target IN ({in_list(lx.TARGETS_A_L)}) GROUP BY target, round(frac, 6)"""
    ),
)
def q_occurrence_by_target(spark, sf_dir):
    return cv.occurrence_by_target(occ_turn(spark, sf_dir, "describer"), lx.TARGETS_A_L)


# --- status / event time ----------------------------------------------------------

S6 = ["game_id", "target", "stage_num", "structure", "group_size", "paper_id"]

_STATUS_SQL = f""", tn AS (SELECT * FROM to_next_f WHERE paper_id NOT IN ({in_list(EXCLUDED)})),
 er AS (SELECT DISTINCT {', '.join(S6)}, rep_num FROM e_desc_fuzzy),
 s1 AS (SELECT tn.*, CASE WHEN er.rep_num IS NOT NULL THEN 1 END AS convention_formed FROM tn LEFT JOIN er ON {_ns('tn', 'er', S6)} AND tn.later = er.rep_num),
 s2 AS (SELECT *, last_value(convention_formed IGNORE NULLS) OVER (PARTITION BY game_id, target, stage_num ORDER BY later ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc FROM s1),
 s3 AS (SELECT s2.*, coalesce(s2.pc, CASE WHEN f.rep_num IS NOT NULL THEN 1 END) AS post_convention FROM s2 LEFT JOIN (SELECT * FROM er WHERE rep_num = 1) f ON {_ns('s2', 'f', S6)}),
 st AS (SELECT * EXCLUDE (pc), coalesce(post_convention, 0) + coalesce(convention_formed, 0) AS code FROM s3),
 status AS (SELECT * EXCLUDE (code), CASE code WHEN 0 THEN 'pre' WHEN 2 THEN 'form' WHEN 1 THEN 'post' END AS convention_status,
   CAST(CASE code WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 END AS INTEGER) AS status_ord FROM st),
 et AS (SELECT t.*, e.rep_num AS convention_round, t.later - e.rep_num AS event_time FROM (SELECT * FROM tn WHERE structure <> 'network-swap') t LEFT JOIN er e ON {_ns('t', 'e', S6)})
"""


def _to_next(spark, sf_dir):
    return fx.to_next_f(spark, sf_dir).where(~F.col("paper_id").isin(list(EXCLUDED)))


def status_df(spark, sf_dir):
    e = cv.earliest(occ_turn(spark, sf_dir, "describer"), "fuzzy_regex", True)
    return cv.conv_status(_to_next(spark, sf_dir), e)


def event_time_df(spark, sf_dir):
    e = cv.earliest(occ_turn(spark, sf_dir, "describer"), "fuzzy_regex", True)
    return cv.event_time(_to_next(spark, sf_dir), e)


@register("conv_status", _sql(_STATUS_SQL + "SELECT * FROM status", "to_next_f"), bench=True)
def q_conv_status(spark, sf_dir):
    return status_df(spark, sf_dir)


@register("event_time", _sql(_STATUS_SQL + "SELECT * FROM et", "to_next_f"))
def q_event_time(spark, sf_dir):
    return event_time_df(spark, sf_dir)


@register(
    "event_time_fit",
    _sql(
        _STATUS_SQL
        + """, both_ AS (SELECT *, 'pre' AS side FROM et WHERE event_time <= 0 UNION ALL SELECT *, 'post' AS side FROM et WHERE event_time >= 0),
 a AS (SELECT structure || CAST(group_size AS VARCHAR) AS grp, side, CAST(regr_count(sim, CAST(event_time AS DOUBLE)) AS BIGINT) AS n,
   regr_slope(sim, CAST(event_time AS DOUBLE)) AS slope, regr_intercept(sim, CAST(event_time AS DOUBLE)) AS intercept, regr_r2(sim, CAST(event_time AS DOUBLE)) AS r2,
   regr_sxx(sim, CAST(event_time AS DOUBLE)) AS sxx, regr_syy(sim, CAST(event_time AS DOUBLE)) AS syy, regr_sxy(sim, CAST(event_time AS DOUBLE)) AS sxy
   FROM both_ GROUP BY structure || CAST(group_size AS VARCHAR), side)
SELECT grp, side, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2,
  round(CASE WHEN n > 2 THEN sqrt(greatest((syy - slope * sxy) / (n - 2), 0.0) / sxx) END, 6) AS slope_se FROM a""",
        "to_next_f",
    ),
)
def q_event_time_fit(spark, sf_dir):
    return cv.event_time_fit(event_time_df(spark, sf_dir))


@register(
    "sim_boxplot",
    _sql(
        _STATUS_SQL
        + """, q AS (SELECT structure, convention_status, count(*) AS n, quantile_cont(sim, 0.25) AS q1, quantile_cont(sim, 0.5) AS median, quantile_cont(sim, 0.75) AS q3
   FROM status WHERE sim IS NOT NULL GROUP BY structure, convention_status)
SELECT q.structure, q.convention_status, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
  round(min(CASE WHEN s.sim >= q.q1 - 1.5 * (q.q3 - q.q1) THEN s.sim END), 6) AS lower_whisker,
  round(max(CASE WHEN s.sim <= q.q3 + 1.5 * (q.q3 - q.q1) THEN s.sim END), 6) AS upper_whisker,
  CAST(count_if(s.sim < q.q1 - 1.5 * (q.q3 - q.q1) OR s.sim > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_outliers
FROM q JOIN status s ON s.structure IS NOT DISTINCT FROM q.structure AND s.convention_status IS NOT DISTINCT FROM q.convention_status AND s.sim IS NOT NULL
GROUP BY q.structure, q.convention_status, q.n, q.q1, q.median, q.q3""",
        "to_next_f",
    ),
)
def q_sim_boxplot(spark, sf_dir):
    return cv.sim_boxplot(status_df(spark, sf_dir))
