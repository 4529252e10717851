"""Star / merge query keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convoscope.functions import lexicon as lx
from convoscope.operators import star as st
from convoscope.plans import fixtures as fx
from convoscope.plans.registry import register
from convoscope.plans.sqlparts import in_list
from convoscope.session import shared_path
from convoscope.sources.csv import read_all, read_csv_dir, write_csv

ID_SUFFIX = {"p0": 6, "p2": 2}
EXCLUDED = ("p1",)


def trials_full(spark, sf_dir):
    return st.star_trials(fx.trials_f(spark, sf_dir), fx.conditions_f(spark, sf_dir))


def messages_full(spark, sf_dir):
    return st.star_messages(trials_full(spark, sf_dir), fx.messages_f(spark, sf_dir))


def choices_full(spark, sf_dir):
    return st.star_choices(trials_full(spark, sf_dir), fx.choices_f(spark, sf_dir))


def _views(body: str, *extra: str) -> str:
    return fx.with_views("", "conditions_f", "trials_f", *extra).rstrip() + _STAR_SQL + body


_STAR_SQL = f""", cnd AS (SELECT dataset_id, condition_id, group_size, CASE WHEN structure IN ({in_list(lx.STRUCTURE_LEVELS)}) THEN structure END AS structure, language FROM conditions_f),
 st AS (SELECT t.dataset_id, t.condition_id, t.trial_id, t.game_id, t.rep_num, t.trial_num, t.stage_num, t.target, t.option_set, c.group_size, c.structure, c.language
   FROM trials_f t LEFT JOIN cnd c ON t.dataset_id = c.dataset_id AND t.condition_id = c.condition_id)
"""
_SM_SQL = """, sm AS (SELECT st.*, m.message_number, m.player_id AS player_num, m.role, m.text, m.message_irrelevant
   FROM st LEFT JOIN messages_f m ON st.dataset_id = m.dataset_id AND st.trial_id = m.trial_id)
"""
_SC_SQL = """, sc AS (SELECT st.*, c.choice_id, c.player_id AS player_num, c.choice
   FROM st LEFT JOIN choices_f c ON st.dataset_id = c.dataset_id AND st.trial_id = c.trial_id AND st.option_set = c.option_set
   WHERE st.dataset_id IN (SELECT DISTINCT dataset_id FROM choices_f))
"""
_OPT = "CASE WHEN option_set IS NOT NULL THEN CAST(len(string_split(option_set, ';')) AS INTEGER) END"


@register("star_trials", _views("SELECT * FROM st"))
def q_star_trials(spark, sf_dir):
    return trials_full(spark, sf_dir)


@register("star_messages", _views(_SM_SQL + "SELECT * FROM sm", "messages_f"))
def q_star_messages(spark, sf_dir):
    return messages_full(spark, sf_dir)


@register("star_choices", _views(_SC_SQL + "SELECT * FROM sc", "choices_f"))
def q_star_choices(spark, sf_dir):
    return choices_full(spark, sf_dir)


@register("merge_trials", _views(f"SELECT * FROM (SELECT *, {_OPT} AS option_size FROM st) WHERE option_size <> 1"))
def q_merge_trials(spark, sf_dir):
    return st.with_option_filter(trials_full(spark, sf_dir))


@register(
    "merge_messages",
    _views(_SM_SQL + f"SELECT * FROM (SELECT *, {_OPT} AS option_size FROM sm) WHERE option_size <> 1", "messages_f"),
    bench=True,
)
def q_merge_messages(spark, sf_dir):
    return st.with_option_filter(messages_full(spark, sf_dir))


@register(
    "merge_choices",
    _views(_SC_SQL + f"SELECT * FROM (SELECT *, {_OPT} AS option_size FROM sc) WHERE option_size <> 1", "choices_f"),
)
def q_merge_choices(spark, sf_dir):
    return st.with_option_filter(choices_full(spark, sf_dir))


@register(
    "option_size_filter",
    fx.with_views(
        f"SELECT dataset_id, trial_id, option_set, {_OPT} AS option_size, ({_OPT}) <> 1 AS kept FROM trials_f",
        "trials_f",
    ),
)
def q_option_size_filter(spark, sf_dir):
    t = fx.trials_f(spark, sf_dir)
    size = F.when(F.col("option_set").isNotNull(), st.option_size())
    return t.select("dataset_id", "trial_id", "option_set", size.alias("option_size"), (size != 1).alias("kept"))


@register(
    "stage_one_trials",
    _views(f"SELECT * FROM (SELECT *, {_OPT} AS option_size FROM st) WHERE option_size <> 1 AND stage_num = 1"),
)
def q_stage_one_trials(spark, sf_dir):
    return st.stage_one(st.with_option_filter(trials_full(spark, sf_dir)))


@register(
    "structure_levels",
    _views(
        "SELECT structure, CAST(list_position(["
        + in_list(lx.STRUCTURE_LEVELS)
        + "], structure) AS INTEGER) AS structure_ord, count(*) AS n_trials FROM st WHERE structure IS NOT NULL GROUP BY structure"
    ),
)
def q_structure_levels(spark, sf_dir):
    """Levels in use (unused levels dropped), in level order, with trial counts."""
    t = trials_full(spark, sf_dir).where(F.col("structure").isNotNull())
    return t.groupBy("structure").agg(F.count(F.lit(1)).alias("n_trials")).select(
        "structure", st.structure_ord("structure").alias("structure_ord"), "n_trials"
    )


@register(
    "dataset_catalog",
    fx.with_views(
        """SELECT coalesce(t.dataset_id, m.dataset_id) AS dataset_id, coalesce(t.n_trials, 0) AS n_trials, coalesce(m.n_messages, 0) AS n_messages
FROM (SELECT dataset_id, count(*) AS n_trials FROM trials_f GROUP BY dataset_id) t
FULL JOIN (SELECT dataset_id, count(*) AS n_messages FROM messages_f GROUP BY dataset_id) m ON t.dataset_id = m.dataset_id""",
        "trials_f",
        "messages_f",
    ),
)
def q_dataset_catalog(spark, sf_dir):
    t = fx.trials_f(spark, sf_dir).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_trials"))
    m = fx.messages_f(spark, sf_dir).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_messages"))
    j = t.join(m, "dataset_id", "full")
    return j.select("dataset_id", F.coalesce("n_trials", F.lit(0)).alias("n_trials"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def _trim_sql():
    parts = " ".join(
        f"WHEN dataset_id = '{d}' THEN substring(game_id, 1, greatest(length(game_id) - {n}, 0))" for d, n in ID_SUFFIX.items()
    )
    return f"CASE {parts} ELSE game_id END"


@register(
    "normalize_ids",
    _views(
        _SM_SQL
        + f"""SELECT dataset_id, condition_id, trial_id, {_trim_sql()} AS game_id, rep_num, trial_num, stage_num, target, option_set,
  group_size, structure, language, message_number, player_num, role, coalesce(text, '') AS text, message_irrelevant, CAST(CASE WHEN dataset_id = 'p3' THEN 5 WHEN structure = 'network-swap' THEN 12 ELSE 6 END AS INTEGER) AS last_rep
FROM sm WHERE dataset_id NOT IN ({in_list(EXCLUDED)}) AND player_num IS NOT NULL""",
        "messages_f",
    ),
)
def q_normalize_ids(spark, sf_dir):
    return st.normalize_ids(messages_full(spark, sf_dir), exclude_datasets=EXCLUDED, id_suffix=ID_SUFFIX, last_rep={"p3": 5}, last_rep_structure={"network-swap": 12})


@register("scan_csv_roundtrip", _views("SELECT * FROM st"))
def q_scan_csv_roundtrip(spark, sf_dir):
    """star_trials written as CSV, one directory per dataset (missing values as
    empty fields), in the shared checkpoint folder; then read back in one scan
    with a declared schema and the dataset label recovered from the path."""
    t = trials_full(spark, sf_dir)
    root = shared_path(spark, "csv_roundtrip", uuid.uuid4().hex)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema.fields if f.name != "dataset_id")
    write_csv(t, root, partition_by=("dataset_id",))
    back = read_csv_dir(spark, root, schema).withColumn(
        "dataset_id", F.regexp_extract(F.col("_metadata.file_path"), "dataset_id=([^/]+)/", 1)
    )
    return back.select(*t.columns)


@register(
    "merge_csv_datasets",
    fx.with_views(
        """SELECT dataset_id, trial_id, message_number, player_id, role, text,
  CASE WHEN dataset_id <> 'p3' THEN message_irrelevant END AS message_irrelevant, CASE WHEN dataset_id = 'p2' THEN role END AS note
FROM messages_f""",
        "messages_f",
    ),
)
def q_merge_csv_datasets(spark, sf_dir):
    """messages_f written as one CSV table per dataset, each with a header of its
    own (another column order, a column more, a column less), then read back
    and united by name."""
    m = fx.messages_f(spark, sf_dir)
    root = shared_path(spark, "csv_datasets", uuid.uuid4().hex)
    cols = [c for c in m.columns if c != "dataset_id"]
    headers = {"p0": cols, "p1": cols[::-1], "p2": ["note", *cols], "p3": [c for c in cols if c != "message_irrelevant"]}
    for dataset, header in headers.items():  # four datasets by definition of the fixture
        part = m.where(F.col("dataset_id") == dataset).withColumn("note", F.col("role"))
        write_csv(part.select(*header), f"{root}/{dataset}/messages.csv")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields if f.name != "dataset_id")
    back = read_all(spark, root, "messages", schema)  # datasets found by listing
    return back.select(*m.columns, "note")
