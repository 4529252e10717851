"""Text-feature query keys (hedges, pronouns, nominals, first word, categories)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoscope.functions import lexicon as lx
from convoscope.operators import features as ft
from convoscope.operators.numbering import numbered
from convoscope.plans import fixtures as fx
from convoscope.plans.registry import register
from convoscope.plans.sqlparts import first_token_sql, hedge_sql, in_list, sentences_sql, tokens_sql


def messages_of_docs(spark, sf_dir):
    """Describers' messages alone: what needs no column of the trials needs no join."""
    d = fx.docs_f(spark, sf_dir)
    return d.select("doc_id", "dataset_id", "role", "text").where(F.col("role") == "describer")


def describers_from_docs(spark, sf_dir, feature=None):
    """docs_f split into a message side and a trial side, re-joined (J4); with
    ``feature`` the messages are reduced to it before the join."""
    d = fx.docs_f(spark, sf_dir)
    msgs = d.select("doc_id", "dataset_id", "role", "text")
    trials = d.select("doc_id", "rep_num", "target")
    return ft.describer_messages(msgs, trials, keys=("doc_id",), cols=("rep_num", "target"), feature=feature)


def _hedged(phrases=lx.HEDGES):
    return lambda m: ft.with_hedges(m, phrases).select("doc_id", "dataset_id", "hedge_count")


def _token_counts(m):
    return ft.message_token_counts(m, ["doc_id"])


DESCRIBERS_SQL = """, m AS (SELECT doc_id, dataset_id, role, text FROM docs_f),
 tr AS (SELECT doc_id, rep_num, target FROM docs_f),
 d AS (SELECT m.*, tr.rep_num, tr.target FROM m LEFT JOIN tr USING (doc_id) WHERE m.role = 'describer')
"""


def _with_docs(body: str) -> str:
    return fx.with_views("", "docs_f").rstrip() + DESCRIBERS_SQL + body


TOKENS_SQL = f""", tk AS (SELECT doc_id, rep_num, target, unnest({tokens_sql('text')}) AS token FROM d),
 tkp AS (SELECT *, {lx.pos_sql('token')} AS pos FROM tk)
"""


@register(
    "hedge_by_rep",
    _with_docs(
        f"SELECT rep_num, round(avg({hedge_sql('text')}), 6) AS hedge_count FROM d "
        "WHERE rep_num IS NOT NULL GROUP BY rep_num"
    ),
    bench=True,
)
def q_hedge_by_rep(spark, sf_dir):
    return ft.hedge_by_rep(describers_from_docs(spark, sf_dir, _hedged()))


@register(
    "hedge_by_rep_dataset",
    _with_docs(
        f"SELECT dataset_id, rep_num, round(avg({hedge_sql('text')}), 6) AS hedge_count FROM d "
        "WHERE rep_num IS NOT NULL AND dataset_id IS NOT NULL GROUP BY dataset_id, rep_num"
    ),
)
def q_hedge_by_rep_dataset(spark, sf_dir):
    return ft.hedge_by_rep(describers_from_docs(spark, sf_dir, _hedged()), keys=("dataset_id", "rep_num"))


@register(
    "hedge_frequency",
    _with_docs(
        f"SELECT rep_num, round(avg({hedge_sql('text', lx.HEDGES_FREQUENCY)}), 6) AS hedge_count FROM d "
        "WHERE rep_num IS NOT NULL GROUP BY rep_num"
    ),
)
def q_hedge_frequency(spark, sf_dir):
    return ft.hedge_by_rep(describers_from_docs(spark, sf_dir, _hedged(lx.HEDGES_FREQUENCY)))


_TOKEN_TABLE_SQL = f""", s AS (SELECT doc_id, {sentences_sql('text')} AS sents FROM d),
 s2 AS (SELECT doc_id, unnest(sents) AS sentence, unnest(range(1, len(sents) + 1)) AS sentence_id FROM s),
 t AS (SELECT doc_id, sentence_id, regexp_extract_all(lower(sentence), '[a-z]+') AS toks FROM s2),
 tt AS (SELECT doc_id, CAST(sentence_id AS INTEGER) AS sentence_id, CAST(unnest(range(1, len(toks) + 1)) AS INTEGER) AS token_id, unnest(toks) AS token FROM t)
"""


@register("token_table", _with_docs(_TOKEN_TABLE_SQL + "SELECT * FROM tt"))
def q_token_table(spark, sf_dir):
    return ft.token_table(messages_of_docs(spark, sf_dir))


@register(
    "token_pos",
    _with_docs(_TOKEN_TABLE_SQL + f"SELECT *, {lx.pos_sql('token')} AS pos FROM tt"),
)
def q_token_pos(spark, sf_dir):
    return ft.tag_tokens(ft.token_table(messages_of_docs(spark, sf_dir)))


_FIRST_SQL = f""", ftk AS (SELECT *, {first_token_sql('text')} AS tok FROM d),
 fw AS MATERIALIZED (SELECT doc_id, dataset_id, role, text, rep_num, target,
   ({lx.pos_sql('tok')}) = 'VERB' AS V_first,
   tok IN ({in_list(lx.DEFINITE_WORDS)}) AS the_first,
   tok IN ({in_list(lx.INDEFINITE_WORDS)}) AS indef_first,
   (({lx.pos_sql('tok')}) IN ('NOUN', 'ADJ') AND tok <> '{lx.NOT_BARE_NOUN}') AS bare_noun_first
   FROM ftk)
"""


def firstword_tags_df(spark, sf_dir):
    """Flags alone, with rounds attached."""
    return describers_from_docs(spark, sf_dir, lambda m: ft.firstword_tags(m).select("doc_id", *ft.FLAGS))


@register("firstword_tags", _with_docs(_FIRST_SQL + "SELECT * FROM fw"))
def q_firstword_tags(spark, sf_dir):
    return describers_from_docs(spark, sf_dir, ft.firstword_tags)


@register(
    "firstword_audit",
    _with_docs(
        _FIRST_SQL
        + """, tc AS (SELECT CAST(V_first AS INTEGER) + CAST(the_first AS INTEGER) + CAST(indef_first AS INTEGER) + CAST(bare_noun_first AS INTEGER) AS tc FROM fw)
SELECT count(*) AS n_messages, CAST(count_if(tc > 1) AS BIGINT) AS n_multi, CAST(count_if(tc IS NULL) AS BIGINT) AS n_untagged, CAST(count_if(tc < 1) AS BIGINT) AS n_none FROM tc"""
    ),
)
def q_firstword_audit(spark, sf_dir):
    return ft.firstword_audit(ft.firstword_tags(messages_of_docs(spark, sf_dir)))


_LONG_SQL = """, lg AS (
  SELECT doc_id, rep_num, 'V_first' AS first_type FROM fw WHERE V_first IS NOT NULL AND V_first
  UNION ALL SELECT doc_id, rep_num, 'the_first' FROM fw WHERE V_first IS NOT NULL AND the_first
  UNION ALL SELECT doc_id, rep_num, 'indef_first' FROM fw WHERE V_first IS NOT NULL AND indef_first
  UNION ALL SELECT doc_id, rep_num, 'bare_noun_first' FROM fw WHERE V_first IS NOT NULL AND bare_noun_first)
"""


@register("firstword_long", _with_docs(_FIRST_SQL + _LONG_SQL + "SELECT * FROM lg"))
def q_firstword_long(spark, sf_dir):
    return ft.firstword_long(firstword_tags_df(spark, sf_dir))


@register(
    "firstword_counts",
    _with_docs(_FIRST_SQL + _LONG_SQL + "SELECT first_type, count(*) AS n FROM lg GROUP BY first_type"),
)
def q_firstword_counts(spark, sf_dir):
    return ft.firstword_counts(firstword_tags_df(spark, sf_dir))


@register(
    "firstword_props",
    _with_docs(
        _FIRST_SQL
        + """, a AS (SELECT rep_num, count(*) AS total_rows,
   CAST(sum(CAST(V_first AS INTEGER)) AS BIGINT) AS v, CAST(sum(CAST(the_first AS INTEGER)) AS BIGINT) AS th,
   CAST(sum(CAST(indef_first AS INTEGER)) AS BIGINT) AS ind, CAST(sum(CAST(bare_noun_first AS INTEGER)) AS BIGINT) AS bn
   FROM fw WHERE V_first IS NOT NULL GROUP BY rep_num)
SELECT rep_num, total_rows, 'proportion_v_first' AS kind, round(v / total_rows, 6) AS proportion FROM a
UNION ALL SELECT rep_num, total_rows, 'proportion_the_first', round(th / total_rows, 6) FROM a
UNION ALL SELECT rep_num, total_rows, 'proportion_indef_first', round(ind / total_rows, 6) FROM a
UNION ALL SELECT rep_num, total_rows, 'proportion_barenoun_first', round(bn / total_rows, 6) FROM a"""
    ),
)
def q_firstword_props(spark, sf_dir):
    return ft.firstword_props(firstword_tags_df(spark, sf_dir))


_PER_DOC_SQL = (
    TOKENS_SQL
    + f""", pd AS (SELECT doc_id, CAST(count_if(pos = 'PRON') AS BIGINT) AS pronoun_count,
   CAST(count_if(pos IN ({in_list(lx.NOMINAL_POS)})) AS BIGINT) AS num_nominals,
   CAST(count_if(pos NOT IN ({in_list(lx.NOMINAL_POS)})) AS BIGINT) AS num_non_nominals FROM tkp GROUP BY doc_id),
 dm AS (SELECT d.*, coalesce(pd.pronoun_count, 0) AS pronoun_count, coalesce(pd.num_nominals, 0) AS num_nominals,
   coalesce(pd.num_non_nominals, 0) AS num_non_nominals, {hedge_sql('d.text')} AS hedge_count FROM d LEFT JOIN pd USING (doc_id)),
 nz AS (SELECT *, num_nominals / (num_nominals + num_non_nominals) AS prop_nominal FROM dm WHERE num_nominals + num_non_nominals > 0)
"""
)


@register(
    "pronoun_by_rep",
    _with_docs(
        _PER_DOC_SQL
        + "SELECT rep_num, round(avg(pronoun_count), 6) AS avg_pronoun_count FROM dm WHERE rep_num IS NOT NULL GROUP BY rep_num"
    ),
)
def q_pronoun_by_rep(spark, sf_dir):
    return ft.pronoun_by_rep(describers_from_docs(spark, sf_dir, _token_counts))


@register(
    "nominal_share",
    _with_docs(
        _PER_DOC_SQL
        + "SELECT rep_num, round(avg(prop_nominal), 6) AS prop_nominal FROM nz WHERE rep_num IS NOT NULL GROUP BY rep_num"
    ),
)
def q_nominal_share(spark, sf_dir):
    return ft.nominal_share(describers_from_docs(spark, sf_dir, _token_counts))


@register(
    "nominal_rolling",
    _with_docs(
        _PER_DOC_SQL
        + """, r AS (SELECT rep_num, avg(prop_nominal) AS prop_nominal FROM nz WHERE rep_num IS NOT NULL GROUP BY rep_num)
SELECT rep_num, round(prop_nominal, 6) AS prop_nominal, CASE WHEN count(prop_nominal) OVER w = 3 THEN round(avg(prop_nominal) OVER w, 6) END AS rolling
FROM r WINDOW w AS (ORDER BY rep_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
    ),
)
def q_nominal_rolling(spark, sf_dir):
    return ft.nominal_rolling(describers_from_docs(spark, sf_dir, _token_counts))


@register(
    "feature_panel",
    _with_docs(
        _PER_DOC_SQL
        + """SELECT rep_num, 'Pronoun Count' AS metric, round(avg(pronoun_count), 6) AS value FROM dm WHERE rep_num IS NOT NULL GROUP BY rep_num
UNION ALL SELECT rep_num, 'Nominal Proportion', round(avg(prop_nominal), 6) FROM nz WHERE rep_num IS NOT NULL GROUP BY rep_num
UNION ALL SELECT rep_num, 'Hedge Count', round(avg(hedge_count), 6) FROM nz WHERE rep_num IS NOT NULL GROUP BY rep_num"""
    ),
)
def q_feature_panel(spark, sf_dir):
    return ft.feature_panel(describers_from_docs(spark, sf_dir, ft.panel_counts))


_CAT_VALUES = lx.values_sql(sorted(lx.pronoun_categories().items()), ["word", "category"])
_PRON_SQL = (
    TOKENS_SQL
    + f""", pk AS (SELECT tkp.rep_num, tkp.token, coalesce(cv.category, 'other') AS category FROM tkp LEFT JOIN {_CAT_VALUES} cv ON tkp.token = cv.word
   WHERE tkp.pos = 'PRON' OR cv.word IS NOT NULL)
"""
)


@register(
    "pronoun_categories",
    _with_docs(
        _PRON_SQL
        + """, c AS (SELECT rep_num, category, count(*) AS count FROM pk WHERE rep_num IS NOT NULL GROUP BY rep_num, category),
 n AS (SELECT rep_num, count(*) AS n_messages FROM d WHERE rep_num IS NOT NULL GROUP BY rep_num)
SELECT c.rep_num, c.category, c.count, n.n_messages, round(c.count / n.n_messages, 6) AS avg_count_per_msg FROM c JOIN n USING (rep_num)"""
    ),
)
def q_pronoun_categories(spark, sf_dir):
    return ft.pronoun_categories(describers_from_docs(spark, sf_dir, ft.message_categories))


@register(
    "personal_pronouns",
    _with_docs(_PRON_SQL + "SELECT token AS pronoun, count(*) AS count FROM pk WHERE category = 'personal' GROUP BY token"),
)
def q_personal_pronouns(spark, sf_dir):
    return ft.personal_pronouns(messages_of_docs(spark, sf_dir))


_GENDER_VALUES = lx.values_sql(sorted(lx.gender_of().items()), ["word", "category"])
_GRID = lx.values_sql(
    [(t, c, ti + 1, ci + 1) for ti, t in enumerate(lx.TARGETS_A_L) for ci, c in enumerate(lx.GENDER_ORDER)],
    ["target", "category", "target_ord", "category_ord"],
)


@register(
    "gender_by_target",
    _with_docs(
        TOKENS_SQL
        + f""", gc AS (SELECT tk.target, gv.category, count(*) AS count FROM tk JOIN {_GENDER_VALUES} gv ON tk.token = gv.word
   WHERE tk.target IN ({in_list(lx.TARGETS_A_L)}) GROUP BY tk.target, gv.category)
SELECT g.target, g.category, CAST(coalesce(gc.count, 0) AS BIGINT) AS count, CAST(g.target_ord AS INTEGER) AS target_ord, CAST(g.category_ord AS INTEGER) AS category_ord
FROM {_GRID} g LEFT JOIN gc ON g.target = gc.target AND g.category = gc.category"""
    ),
)
def q_gender_by_target(spark, sf_dir):
    return ft.gender_by_target(describers_from_docs(spark, sf_dir, ft.message_genders))


@register(
    "describer_messages",
    fx.with_views(
        """SELECT m.*, t.rep_num FROM messages_f m LEFT JOIN (SELECT dataset_id, trial_id, rep_num FROM trials_f) t
 USING (dataset_id, trial_id) WHERE m.role = 'describer'""",
        "trials_f",
        "messages_f",
    ),
)
def q_describer_messages(spark, sf_dir):
    return ft.describer_messages(fx.messages_f(spark, sf_dir), fx.trials_f(spark, sf_dir))


@register(
    "message_ids",
    fx.with_views(
        """SELECT * EXCLUDE (role) FROM (SELECT dataset_id, trial_id, message_number, role, text,
  row_number() OVER (ORDER BY dataset_id, trial_id, message_number) AS doc_id FROM messages_f) WHERE role = 'describer'""",
        "messages_f",
    ),
)
def q_message_ids(spark, sf_dir):
    """All messages numbered in order from 1, then the describers' kept (ids show the gaps)."""
    m = fx.messages_f(spark, sf_dir).select("dataset_id", "trial_id", "message_number", "role", "text")
    n = numbered(m, "dataset_id", "trial_id", "message_number", name="doc_id")
    return n.withColumn("doc_id", F.col("doc_id") + 1).where(F.col("role") == "describer").drop("role")
