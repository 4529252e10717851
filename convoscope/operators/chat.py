"""Per-trial text aggregates: word totals, concatenated text, nested message
lists and role-tagged transcripts.

A trial's messages are one group; groups are bounded by the length of a
conversation, and every aggregate here is a single value per trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.functions.text import word_count

WORD_KEYS = [
    "dataset_id", "condition_id", "game_id", "trial_num", "rep_num", "target",
    "group_size", "structure", "option_size", "stage_num",
]


def words_per_trial(messages_full: DataFrame, keys: Sequence[str] = WORD_KEYS) -> DataFrame:
    """Sum of single-space word counts of relevant describer messages per trial
    (NULL ``message_irrelevant`` counts as relevant)."""
    m = messages_full.where(
        (F.col("role") == "describer")
        & ~F.coalesce(F.col("message_irrelevant"), F.lit(False))
        & F.col("text").isNotNull()
    )
    agg = m.groupBy(*keys).agg(F.sum(word_count("text")).cast("bigint").alias("total_num_words"))
    return agg.where(F.col("total_num_words").isNotNull())


def concat_text(df: DataFrame, keys: Sequence[str], sep: str = ", ", order: str = "message_number", text: str = "text") -> DataFrame:
    """Texts of a group joined in ``order`` (explicit: file order is not a
    contract in a distributed scan)."""
    return df.groupBy(*keys).agg(
        F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias(text)
    )


def nest_messages(messages: DataFrame, key: str = "trial_id", extra_keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """One row per trial with ``messages: array<struct<message_number, text,
    player_id, role>>`` sorted by message number."""
    s = F.struct("message_number", "text", "player_id", "role")
    return messages.groupBy(*extra_keys, key).agg(F.array_sort(F.collect_list(s)).alias("messages"))


def flatten_nested(nested: DataFrame, key: str = "trial_id", extra_keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    x = nested.select(*extra_keys, key, F.posexplode("messages").alias("pos", "m"))
    return x.select(*extra_keys, key, "pos", "m.message_number", "m.player_id", "m.role", "m.text")


def chat_prompts(trials: DataFrame, messages: DataFrame, keys: Sequence[str] = ("dataset_id", "trial_id")) -> DataFrame:
    """Per trial a transcript ``"role: text\\n"`` per message in message order
    (empty when the trial has no messages; missing text renders as empty), and
    the target as the label."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    per_trial = messages.select(*keys, "message_number", line.alias("line")).groupBy(*keys).agg(
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY message_number)").alias("user_message")
    )
    t = trials.select(*keys, "game_id", "rep_num", "trial_num", F.col("target").alias("label"))
    j = t.join(per_trial, list(keys), "left")
    return j.withColumn("user_message", F.coalesce("user_message", F.lit("")))


def markup_rewrite(pages: DataFrame, replacements: Sequence[tuple[str, str]], prefix: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Text-file job: pick documents by a prefix, newlines to spaces, chained
    literal replacements."""
    p = pages if prefix is None else pages.where(F.col(url).startswith(prefix))
    h = F.replace(F.col(html), F.lit("\n"), F.lit(" "))
    for old, new in replacements:
        h = F.replace(h, F.lit(old), F.lit(new))
    return p.withColumn(html, h)
