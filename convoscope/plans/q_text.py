"""Per-trial text query keys: word totals, concatenation, cleaning, nesting,
chat transcripts, markup rewrite."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions.text import clean_text
from convoscope.operators import chat
from convoscope.operators import star as st
from convoscope.plans import fixtures as fx
from convoscope.plans.q_star import _SM_SQL, _views, messages_full
from convoscope.plans.registry import register
from convoscope.plans.sqlparts import clean_sql
from convoscope.sources.tables import table

# FIXED VALUES -- the literal rewrites of the markup job, in order.
MARKUP_REPLACEMENTS = [
    ('fill="lightgray"', 'fill="black"'),
    ('stroke="white" strokewidth="1"', 'stroke="black" strokewidth="2"'),
]
# what the test pages hold: every page has this style
PAGE_REPLACEMENTS = [("<style>p{margin:0}</style>", "<style>p{margin:1em}</style>")]
MARKUP_PREFIX = "https://"

_OPT = "CASE WHEN option_set IS NOT NULL THEN CAST(len(string_split(option_set, ';')) AS INTEGER) END"
_MERGED_SQL = _SM_SQL + f""", mm AS (SELECT * FROM (SELECT *, {_OPT} AS option_size FROM sm) WHERE option_size <> 1 AND stage_num = 1)
"""


def merged_stage_one(spark, sf_dir):
    return st.stage_one(st.with_option_filter(messages_full(spark, sf_dir)))


@register(
    "words_per_trial",
    _views(
        _MERGED_SQL
        + """SELECT * FROM (SELECT dataset_id, condition_id, game_id, trial_num, rep_num, target, group_size, structure, option_size, stage_num,
   CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS total_num_words
 FROM mm WHERE role = 'describer' AND NOT coalesce(message_irrelevant, false) AND text IS NOT NULL
 GROUP BY dataset_id, condition_id, game_id, trial_num, rep_num, target, group_size, structure, option_size, stage_num)
WHERE total_num_words IS NOT NULL""",
        "messages_f",
    ),
    bench=True,
)
def q_words_per_trial(spark, sf_dir):
    return chat.words_per_trial(merged_stage_one(spark, sf_dir))


@register(
    "concat_trial_text",
    _views(
        _SM_SQL
        + """SELECT dataset_id, game_id, trial_id, string_agg(coalesce(text, ''), ', ' ORDER BY message_number) AS text
FROM sm WHERE role = 'describer' GROUP BY dataset_id, game_id, trial_id""",
        "messages_f",
    ),
)
def q_concat_trial_text(spark, sf_dir):
    m = messages_full(spark, sf_dir).where(F.col("role") == "describer").withColumn("text", F.coalesce("text", F.lit("")))
    return chat.concat_text(m, ["dataset_id", "game_id", "trial_id"], sep=", ")


@register(
    "clean_text",
    fx.with_views(
        f"SELECT dataset_id, trial_id, message_number, {clean_sql('text')} AS clean FROM messages_f", "messages_f"
    ),
)
def q_clean_text(spark, sf_dir):
    m = fx.messages_f(spark, sf_dir)
    return m.select("dataset_id", "trial_id", "message_number", clean_text("text").alias("clean"))


@register(
    "nest_messages",
    fx.with_views(
        """SELECT dataset_id, trial_id, CAST(row_number() OVER (PARTITION BY dataset_id, trial_id ORDER BY message_number) - 1 AS INTEGER) AS pos,
  message_number, player_id, role, text FROM messages_f""",
        "messages_f",
    ),
)
def q_nest_messages(spark, sf_dir):
    return chat.flatten_nested(chat.nest_messages(fx.messages_f(spark, sf_dir)))


@register(
    "chat_prompts",
    fx.with_views(
        """SELECT t.dataset_id, t.trial_id, t.game_id, t.rep_num, t.trial_num, t.target AS label, coalesce(u.user_message, '') AS user_message
FROM trials_f t LEFT JOIN (SELECT dataset_id, trial_id, string_agg(role || ': ' || coalesce(text, '') || chr(10), '' ORDER BY message_number) AS user_message
  FROM messages_f GROUP BY dataset_id, trial_id) u ON t.dataset_id = u.dataset_id AND t.trial_id = u.trial_id""",
        "trials_f",
        "messages_f",
    ),
)
def q_chat_prompts(spark, sf_dir):
    return chat.chat_prompts(fx.trials_f(spark, sf_dir), fx.messages_f(spark, sf_dir))


def _markup_sql():
    h = "replace(html, chr(10), ' ')"
    for old, new in MARKUP_REPLACEMENTS + PAGE_REPLACEMENTS:
        h = f"replace({h}, '{old}', '{new}')"
    return f"""SELECT page_id, url, length(h) AS n_chars, md5(h) AS digest FROM (SELECT page_id, url, {h} AS h FROM pages WHERE starts_with(url, '{MARKUP_PREFIX}'))"""


@register("markup_rewrite", _markup_sql())
def q_markup_rewrite(spark, sf_dir):
    p = chat.markup_rewrite(table(spark, sf_dir, "pages"), MARKUP_REPLACEMENTS + PAGE_REPLACEMENTS, prefix=MARKUP_PREFIX)
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("digest"))
