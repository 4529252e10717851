"""Null rules on typed rows: what the joins and counts do where a side is missing."""

from pyspark.sql import functions as F

from convoscope.operators import chat
from convoscope.operators import features as ft
from convoscope.operators import star as st

COND = "dataset_id string, condition_id int, group_size int, structure string, language string"
TRIAL = "dataset_id string, trial_id long, condition_id int, option_set string, target int, rep_num int"


def _trials(spark):
    cond = spark.createDataFrame([("p0", 1, 2, "thin", "en"), ("p1", 1, 4, "odd", "en")], COND)
    rows = [("p0", 1, 1, "A;B", 7, 1), ("p0", 2, 9, "A;B;C", 8, 2), ("p1", 1, 1, "A", 9, 1)]
    return st.star_trials(spark.createDataFrame(rows, TRIAL), cond)


def test_unmatched_conditions_and_unknown_levels_are_null(spark):
    got = {(r.dataset_id, r.trial_id): (r.group_size, r.structure, r.target) for r in _trials(spark).collect()}
    assert got == {("p0", 1): (2, "thin", "7"), ("p0", 2): (None, None, "8"), ("p1", 1): (4, None, "9")}


def test_trials_without_messages_stay(spark):
    m = spark.createDataFrame([("p0", 1, 1, 10, None), ("p0", 1, 2, 11, "hi")], "dataset_id string, trial_id long, message_number int, player_id long, text string")
    got = st.star_messages(_trials(spark), m)
    assert sorted((r.dataset_id, r.trial_id, r.message_number or 0, r.text or "") for r in got.collect()) == [
        ("p0", 1, 1, ""), ("p0", 1, 2, "hi"), ("p0", 2, 0, ""), ("p1", 1, 0, "")
    ]


def test_a_dataset_without_choices_vanishes(spark):
    c = spark.createDataFrame([(5, "p0", 1, 10, "A;B", "A")], "choice_id long, dataset_id string, trial_id long, player_id long, option_set string, choice string")
    got = st.star_choices(_trials(spark), c)
    assert sorted((r.dataset_id, r.trial_id, r.choice or "") for r in got.collect()) == [("p0", 1, "A"), ("p0", 2, "")]


def test_base_messages_drop_rows_without_a_player(spark):
    rows = [("p0", "g_room1", "thin", 1, None), ("p0", "g_room1", "thin", None, "x"), ("p1", "g", None, 1, "x"), ("p3", "gg", "network-swap", 2, "y")]
    df = spark.createDataFrame(rows, "dataset_id string, game_id string, structure string, player_num long, text string")
    got = st.normalize_ids(df, id_suffix={"p0": 6}, last_rep={"p3": 5}, last_rep_structure={"network-swap": 12})
    assert sorted((r.dataset_id, r.game_id, r.text, r.last_rep) for r in got.collect()) == [("p0", "g", "", 6), ("p3", "gg", "y", 5)]


def test_features_of_missing_text_and_rounds(spark):
    m = spark.createDataFrame([(1, "describer", "Maybe it is"), (2, "describer", None), (3, "matcher", "maybe"), (4, "describer", "")], "doc_id long, role string, text string")
    t = spark.createDataFrame([(1, 1), (2, 1), (4, None)], "doc_id long, rep_num int")
    hedged = ft.describer_messages(m, t, ("doc_id",), ("rep_num",), lambda d: ft.with_hedges(d).select("doc_id", "hedge_count"))
    assert "text" not in hedged.columns
    assert [(r.rep_num, r.hedge_count) for r in ft.hedge_by_rep(hedged).collect()] == [(1, 0.5)]
    counted = ft.describer_messages(m, t, ("doc_id",), ("rep_num",), lambda d: ft.message_token_counts(d, ["doc_id"]))
    assert counted.count() == 3 and ft.pronoun_by_rep(counted).first().avg_pronoun_count == 0.5
    cats = ft.describer_messages(m, t, ("doc_id",), ("rep_num",), ft.message_categories)
    assert {r.n_messages for r in ft.pronoun_categories(cats).collect()} == {2}


def test_words_of_irrelevant_or_missing_messages_do_not_count(spark):
    rows = [("p0", 1, "g", 1, 1, "A", 2, "thin", 2, 1, "describer", irrelevant, text) for irrelevant, text in ((None, "one two"), (False, "three"), (True, "x y z"), (None, None))]
    cols = "dataset_id string, condition_id int, game_id string, trial_num int, rep_num int, target string, group_size int, structure string, option_size int, stage_num int, role string, message_irrelevant boolean, text string"
    got = chat.words_per_trial(spark.createDataFrame(rows, cols))
    assert got.select(F.sum("total_num_words")).first()[0] == 3
