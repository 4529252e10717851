"""When did a group's final convention first appear?

Input: one flat row per message with the game keys (``rounds``: game_id,
paper_id, target, structure, group_size, stage_num, rep_num, message_number,
player_num, role, text).  ``structure`` may be NULL, so every join on the game
keys is null-safe.

Plan shape: the convention table (one row per game x final describer) joins the
per-message (or per-turn) texts on the five game keys; flags are column
expressions; "earliest" and "ever" are a grouped ``min`` joined back, not a
window over a whole game, so a hot game is split by AQE's skew handling
instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoscope.functions.text import clean_text, fuzzy_contains
from convoscope.operators.joins import broadcast_if_small, join_null_safe
from convoscope.operators.quantiles import exact_quantiles
from convoscope.operators.star import last_round

GAME_KEYS = ["game_id", "target", "paper_id", "structure", "group_size"]
TURN_KEYS = ["game_id", "player_num", "target", "stage_num", "rep_num", "trial_num", "paper_id", "role", "structure", "group_size"]


def base_messages(
    rounds: DataFrame,
    exclude_papers: Sequence[str] = ("p1",),
    last_rep: int = 6,
    by_paper: Mapping[str, int] | None = None,
    by_structure: Mapping[str, int] | None = None,
) -> DataFrame:
    """Drop excluded papers and rows without a player; missing text -> ''; the last
    round by paper, else by structure, else ``last_rep``."""
    df = rounds.where(~F.col("paper_id").isin(list(exclude_papers))).where(F.col("player_num").isNotNull())
    last = last_round("paper_id", "structure", by_paper or {}, by_structure or {}, last_rep)
    return df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("last_rep", last)


def conventions(base: DataFrame) -> DataFrame:
    """Describer text of the last round, concatenated in message order per
    (game keys, round, describer), cleaned; empty conventions dropped."""
    end = base.where((F.col("role") == "describer") & (F.col("rep_num") == F.col("last_rep")))
    keys = GAME_KEYS + ["rep_num", "player_num"]
    agg = end.groupBy(*keys).agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY message_number)").alias("raw")
    )
    out = agg.select(*GAME_KEYS, F.col("player_num").alias("conv_desc"), clean_text("raw").alias("convention"))
    return out.where(F.col("convention") != "")


def _flags(joined: DataFrame, dedupe: bool = True, fuzzy: bool = True) -> DataFrame:
    """Exact and approximate containment of the convention in the text.

    Without ``fuzzy`` only the exact flag, a built-in expression in the row.
    With ``dedupe`` the (text, convention) pairs are matched once and joined
    back: short utterances repeat a lot, and the approximate test is the
    expensive part of the plan.  Both flags are built-in expressions."""
    base = F.contains("text", "convention").cast("int").alias("base_regex")
    if not fuzzy:
        return joined.select("*", base)
    near = fuzzy_contains(F.col("convention"), F.col("text")).cast("int").alias("fuzzy_regex")
    if not dedupe:
        return joined.select("*", base, near)
    pairs = joined.select("text", "convention").distinct().select("text", "convention", base, near)
    return joined.join(pairs, ["text", "convention"], "inner")


def _same(joined: DataFrame) -> DataFrame:
    """``same``: the speaker is the convention's own describer."""
    return joined.withColumn("same", F.col("conv_desc") == F.col("player_num"))


def occurrence_per_message(base: DataFrame, conv: DataFrame, dedupe: bool = True) -> DataFrame:
    m = base.select(
        "game_id", "target", "stage_num", "trial_num", "rep_num", "message_number", clean_text("text").alias("text"),
        "role", "player_num", "structure", "paper_id", "group_size",
    )
    return _flags(_same(join_null_safe(m, conv, GAME_KEYS, "inner")), dedupe)


def occurrence_per_turn(base: DataFrame, conv: DataFrame, dedupe: bool = True, fuzzy: bool = True, role: str | None = None) -> DataFrame:
    """Texts of one speaker in one trial concatenated (message order), then
    cleaned, then matched; exactly only without ``fuzzy``, of one role if given
    (a filter that reaches the scan)."""
    if role is not None:
        base = base.where(F.col("role") == role)
    t = base.groupBy(*TURN_KEYS).agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY message_number)").alias("raw")
    )
    t = t.select(*TURN_KEYS, clean_text("raw").alias("text"))
    return _flags(_same(join_null_safe(t, conv, GAME_KEYS, "inner")), dedupe, fuzzy=fuzzy)


def earliest(occ: DataFrame, flag: str, describer_only: bool) -> DataFrame:
    """Rows at the earliest round with ``flag == 1`` per game, ties kept."""
    x = occ.where(F.col("role") == "describer") if describer_only else occ
    x = x.where(F.col(flag) == 1)
    first = x.groupBy(*GAME_KEYS).agg(F.min("rep_num").alias("__first"))
    j = join_null_safe(x, first, GAME_KEYS, "inner")
    return j.where(F.col("rep_num") == F.col("__first")).drop("__first")


def locf(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[str], alias: str) -> DataFrame:
    """Forward fill: the last non-NULL value so far within the partition.

    A segmented scan, so that no partition of the data needs a task of its own: rows
    are range-partitioned by (partition, order) and written once; each range fills what
    it holds; the last value that a range has of a partition, one row each, is carried to
    the ranges behind it.  Rows of equal order are always in one range."""
    partition, order = list(partition), list(order)
    ranged = df.repartitionByRange(*partition, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    local = Window.partitionBy("__range", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumn("__local", F.last(F.col(value), ignorenulls=True).over(local))
    position = F.struct(*order)
    last = ranged.groupBy("__range", *partition).agg(F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("__last"))
    earlier = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__range", *partition, F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    out = join_null_safe(filled, carried.where(F.col("__carried").isNotNull()), ["__range", *partition], "left")
    kept = [c for c in df.columns if c != alias]
    return out.select(*kept, F.coalesce("__local", "__carried").alias(alias))


def survival_locf(occ: DataFrame, flag: str = "fuzzy_regex") -> DataFrame:
    """Describer rows with ``occurred`` = the flag filled forward in round order."""
    d = occ.where(F.col("role") == "describer").withColumn("occurred", F.col(flag))
    return locf(d, "occurred", GAME_KEYS, ["rep_num", "player_num", "conv_desc"], "occurred")


def survival_ever(occ: DataFrame, flag: str = "fuzzy_regex") -> DataFrame:
    """Describer rows with ``occurred_by`` = the flag was 1 at this round or any
    earlier one in the game: round >= the game's first flagged round."""
    d = occ.where(F.col("role") == "describer")
    first = d.where(F.col(flag) == 1).groupBy(*GAME_KEYS).agg(F.min("rep_num").alias("__first"))
    j = join_null_safe(d, first, GAME_KEYS, "left")
    occurred = F.coalesce((F.col("rep_num") >= F.col("__first")).cast("int"), F.lit(0))
    return j.withColumn("occurred_by", occurred).drop("__first")


def first_label(rep) -> F.Column:
    r = F.col(rep) if isinstance(rep, str) else rep
    return F.when(r > 6, F.lit("7+")).otherwise(r.cast("string"))


def first_share(earliest_rows: DataFrame) -> DataFrame:
    """Share of each first round within (structure, group_size)."""
    c = earliest_rows.groupBy("structure", "group_size", first_label("rep_num").alias("first")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # one row per (structure, group_size, first): a small table
    w = Window.partitionBy("structure", "group_size")
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def with_progress(occ: DataFrame) -> DataFrame:
    """``frac`` = round / highest round within (structure, group_size): the max
    is a grouped aggregate, one row per condition, broadcast after a count (a window,
    or a shuffle on so few keys, would put a whole structure in one task)."""
    mx = broadcast_if_small(occ.groupBy("structure", "group_size").agg(F.max("rep_num").alias("__max")))
    j = join_null_safe(occ, mx, ["structure", "group_size"], "inner")
    return j.withColumn("frac", F.col("rep_num") / F.col("__max")).drop("__max")


def occurrence_mean_se(occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard error of both flags along the rounds, per condition, or within it also per ``by``
    (``["game_id"]``: a line per game)."""
    d = with_progress(occ.where(F.col("role") == "describer"))
    d = d.withColumn("grp", F.concat(F.col("structure"), F.col("group_size").cast("string")))
    agg = d.groupBy("structure", "group_size", "grp", *by, "frac").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("base_regex").alias("mean_base"),
        F.stddev_samp("base_regex").alias("sd_base"),
        F.avg("fuzzy_regex").alias("mean_fuzzy"),
        F.stddev_samp("fuzzy_regex").alias("sd_fuzzy"),
    )
    se = lambda sd: F.round(F.col(sd) / F.sqrt(F.col("n")), 6)
    return agg.select(
        "structure", "group_size", "grp", *by, F.round("frac", 6).alias("frac"), "n",
        F.round("mean_base", 6).alias("mean_base"), se("sd_base").alias("se_base"),
        F.round("mean_fuzzy", 6).alias("mean_fuzzy"), se("sd_fuzzy").alias("se_fuzzy"),
    )


def occurrence_by_target(occ: DataFrame, targets: Sequence[str]) -> DataFrame:
    d = with_progress(occ.where(F.col("role") == "describer")).where(F.col("target").isin(list(targets)))
    return d.groupBy("target", F.round("frac", 6).alias("frac")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("fuzzy_regex"), 6).alias("mean_fuzzy")
    )


# --- status and event time over adjacent-round similarity ---------------------

STATUS_KEYS = ["game_id", "target", "stage_num", "structure", "group_size", "paper_id"]


def convention_rounds(earliest_rows: DataFrame, fan_out: bool = False) -> DataFrame:
    """Distinct (game keys, round) of the earliest describer match.  The
    selected columns carry only the round, so duplicate rows (ties, several
    final describers) are exact copies; they are dropped rather than fanning
    out the similarity rows, unless ``fan_out`` asks for one row each."""
    out = earliest_rows.select(*STATUS_KEYS, "rep_num")
    return out if fan_out else out.distinct()


def conv_status(to_next: DataFrame, earliest_rows: DataFrame, fan_out: bool = False) -> DataFrame:
    """pre / form / post for every adjacent-round similarity row."""
    # one row per game: small, used twice below -- checkpoint it so the
    # matching pipeline behind it runs once
    e = convention_rounds(earliest_rows, fan_out).checkpoint()
    formed = e.select(*STATUS_KEYS, F.col("rep_num").alias("later"), F.lit(1).alias("convention_formed"))
    s = join_null_safe(to_next, formed, STATUS_KEYS + ["later"], "left")
    # forward fill in round order per (game, target, stage): a game's rounds
    s = locf(s, "convention_formed", ["game_id", "target", "stage_num"], ["later"], "post_convention")
    first = e.where(F.col("rep_num") == 1).select(*STATUS_KEYS, F.lit(1).alias("convention_first"))
    s = join_null_safe(s, first, STATUS_KEYS, "left")
    s = s.withColumn("post_convention", F.coalesce("post_convention", "convention_first"))
    code = F.coalesce(F.col("post_convention"), F.lit(0)) + F.coalesce(F.col("convention_formed"), F.lit(0))
    status = F.when(code == 0, "pre").when(code == 2, "form").when(code == 1, "post")
    order = F.when(code == 0, 1).when(code == 2, 2).when(code == 1, 3)
    return s.drop("convention_first").withColumn("convention_status", status).withColumn("status_ord", order.cast("int"))


def event_time(
    to_next: DataFrame, earliest_rows: DataFrame, exclude_structure: str = "network-swap", fan_out: bool = False
) -> DataFrame:
    e = convention_rounds(earliest_rows, fan_out).withColumnRenamed("rep_num", "convention_round")
    t = to_next.where(F.col("structure") != exclude_structure)
    j = join_null_safe(t, e, STATUS_KEYS, "left")
    return j.withColumn("event_time", F.col("later") - F.col("convention_round"))


def event_time_fit(et: DataFrame) -> DataFrame:
    """Least-squares line of sim on event time per (structure x group size, side);
    event time 0 belongs to both sides."""
    g = F.concat(F.col("structure"), F.col("group_size").cast("string"))
    # each row lands on its side(s) by one explode, not two filtered copies
    sides = F.filter(
        F.array(F.when(F.col("event_time") <= 0, F.lit("pre")), F.when(F.col("event_time") >= 0, F.lit("post"))),
        lambda s: s.isNotNull(),
    )
    both = et.select("*", F.explode(sides).alias("side")).withColumn("grp", g)
    x, y = F.col("event_time").cast("double"), F.col("sim")
    agg = both.groupBy("grp", "side").agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )
    resid = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest(resid, F.lit(0.0)) / F.col("sxx")))
    return agg.select(
        "grp", "side", "n",
        F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"),
        F.round("r2", 6).alias("r2"), F.round(se, 6).alias("slope_se"),
    )


def sim_boxplot(status: DataFrame) -> DataFrame:
    """Box-plot statistics of ``sim`` per (structure, status): quartiles
    (type 7), whiskers at the most extreme values within 1.5 IQR, outlier count."""
    keys = ["structure", "convention_status"]
    # read by the quantiles and by the whiskers: written once
    vals = status.select(*keys, "sim").checkpoint()
    q = exact_quantiles(vals, keys, "sim", {"q1": 0.25, "median": 0.5, "q3": 0.75}, method="linear").checkpoint()
    j = join_null_safe(vals, broadcast_if_small(q), keys, "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    agg = j.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("sim") >= lo_f, F.col("sim"))).alias("lower_whisker"),
        F.max(F.when(F.col("sim") <= hi_f, F.col("sim"))).alias("upper_whisker"),
        F.count_if((F.col("sim") < lo_f) | (F.col("sim") > hi_f)).alias("n_outliers"),
    )
    return agg.select(
        *keys, "n", *[F.round(c, 6).alias(c) for c in ["q1", "median", "q3", "lower_whisker", "upper_whisker"]], "n_outliers"
    )
