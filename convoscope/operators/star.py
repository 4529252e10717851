"""The harmonised star: conditions, trials, messages, choices across datasets.

Ids restart in every dataset, so every join carries ``dataset_id``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoscope.functions.lexicon import STRUCTURE_LEVELS
from convoscope.operators.joins import broadcast_if_small


def structure_level(structure, levels=STRUCTURE_LEVELS) -> Column:
    """Closed ordered category: a known level keeps its label, anything else
    (unknown label, NULL) becomes NULL."""
    s = F.col(structure) if isinstance(structure, str) else structure
    return F.when(s.isin(list(levels)), s)


def structure_ord(structure, levels=STRUCTURE_LEVELS) -> Column:
    """1-based position of the level, NULL when not a level."""
    s = F.col(structure) if isinstance(structure, str) else structure
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), s)
    return F.when(pos > 0, pos.cast("int"))


def normalize_conditions(conditions: DataFrame) -> DataFrame:
    return conditions.withColumn("structure", structure_level("structure"))


def star_trials(trials: DataFrame, conditions: DataFrame) -> DataFrame:
    """trials ⟕ conditions on (dataset_id, condition_id); target/matchers as text."""
    t = trials
    for c in ("target", "matchers"):
        if c in t.columns:
            t = t.withColumn(c, F.col(c).cast("string"))
    cond = broadcast_if_small(normalize_conditions(conditions))  # a few rows per dataset, counted
    return t.join(cond, ["dataset_id", "condition_id"], "left")


def star_messages(trials_full: DataFrame, messages: DataFrame) -> DataFrame:
    """trials ⟕ messages on (dataset_id, trial_id); trials without messages stay
    (one row with NULL message columns).  ``player_id`` becomes ``player_num``."""
    m = messages.withColumnRenamed("player_id", "player_num")
    return trials_full.join(m, ["dataset_id", "trial_id"], "left")


def star_choices(trials_full: DataFrame, choices: DataFrame) -> DataFrame:
    """trials ⟕ choices on (dataset_id, trial_id, option_set).  A dataset whose
    choices table is empty contributes no rows at all (not trials with NULLs)."""
    c = choices.withColumnRenamed("player_id", "player_num")
    present = c.select("dataset_id").distinct()
    t = trials_full.join(present, "dataset_id", "left_semi")
    return t.join(c, ["dataset_id", "trial_id", "option_set"], "left")


def option_size(option_set="option_set") -> Column:
    """Number of ``;``-separated options (``'A;B;'`` -> 3, NULL -> NULL)."""
    s = F.col(option_set) if isinstance(option_set, str) else option_set
    return F.size(F.split(s, ";")).cast("int")


def with_option_filter(df: DataFrame) -> DataFrame:
    """Add ``option_size`` and drop single-option trials (NULL sizes drop too)."""
    return df.withColumn("option_size", F.when(F.col("option_set").isNotNull(), option_size())).where(
        F.col("option_size") != 1
    )


def stage_one(df: DataFrame, only: bool = True) -> DataFrame:
    return df.where(F.col("stage_num") == 1) if only else df


def last_round(dataset, structure, by_dataset: Mapping[str, int], by_structure: Mapping[str, int], default: int) -> Column:
    """A game's last round: by its dataset, else by its structure, else the default."""
    d, s = (F.col(c) if isinstance(c, str) else c for c in (dataset, structure))
    branches = [(d == k, n) for k, n in by_dataset.items()] + [(s == k, n) for k, n in by_structure.items()]
    out = F.lit(default)
    for cond, n in reversed(branches):
        out = F.when(cond, n).otherwise(out)
    return out.cast("int")


def normalize_ids(
    messages_full: DataFrame,
    exclude_datasets=("p1",),
    id_suffix: Mapping[str, int] | None = None,
    last_rep: Mapping[str, int] | None = None,
    last_rep_structure: Mapping[str, int] | None = None,
    default_last_rep: int = 6,
    dataset_col: str = "dataset_id",
) -> DataFrame:
    """Base messages for the convention analyses: drop excluded datasets and
    rows without a player, missing text -> '', trim a dataset-specific number of
    trailing characters off ``game_id``, attach the last round per dataset and
    structure."""
    id_suffix = dict(id_suffix or {})
    d = F.col(dataset_col)
    df = messages_full.where(~d.isin(list(exclude_datasets))).where(F.col("player_num").isNotNull())
    df = df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    gid = F.col("game_id").cast("string")
    expr = gid
    if id_suffix:
        expr = None
        for ds, n in id_suffix.items():
            trimmed = F.substring(gid, F.lit(1), F.greatest(F.length(gid) - n, F.lit(0)))
            expr = F.when(d == ds, trimmed) if expr is None else expr.when(d == ds, trimmed)
        expr = expr.otherwise(gid)
    df = df.withColumn("game_id", expr)
    return df.withColumn("last_rep", last_round(d, "structure", last_rep or {}, last_rep_structure or {}, default_last_rep))
