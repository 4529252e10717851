from pyspark.sql import functions as F

from convoscope.operators import conventions as cv

TN = "game_id long, paper_id string, target string, structure string, group_size int, stage_num int, later int, sim double"
EA = "game_id long, paper_id string, target string, structure string, group_size int, stage_num int, rep_num int"


def test_status_goldens(spark):
    tn = [(g, "p0", "A", s, 2, 1, later, 0.1 * later) for g, s in ((1, "thin"), (2, "thin"), (3, "thin"), (4, None)) for later in range(2, 7)]
    ea = [(1, "p0", "A", "thin", 2, 1, 4), (1, "p0", "A", "thin", 2, 1, 4),  # tie: duplicate row
          (2, "p0", "A", "thin", 2, 1, 1), (4, "p0", "A", None, 2, 1, 3)]
    st = cv.conv_status(spark.createDataFrame(tn, TN), spark.createDataFrame(ea, EA))
    got = {(r["game_id"], r["later"]): r["convention_status"] for r in st.collect()}
    assert len(got) == 20 and st.count() == 20  # no fan-out from the duplicate
    assert [got[(1, r)] for r in range(2, 7)] == ["pre", "pre", "form", "post", "post"]
    assert [got[(2, r)] for r in range(2, 7)] == ["post"] * 5  # round-1 convention: post, never form
    assert [got[(3, r)] for r in range(2, 7)] == ["pre"] * 5
    assert [got[(4, r)] for r in range(2, 7)] == ["pre", "form", "post", "post", "post"]  # NULL structure joins


def test_fan_out_on_ties_is_an_option(spark):
    tn = spark.createDataFrame([(1, "p0", "A", "thin", 2, 1, later, 0.1) for later in range(2, 7)], TN)
    ea = spark.createDataFrame([(1, "p0", "A", "thin", 2, 1, 4)] * 2, EA)
    assert cv.conv_status(tn, ea).count() == 5
    fanned = cv.conv_status(tn, ea, fan_out=True)
    assert sorted(r["later"] for r in fanned.collect()) == [2, 3, 4, 4, 5, 6]
    assert cv.event_time(tn, ea).count() == 5 and cv.event_time(tn, ea, fan_out=True).count() == 10


def test_last_round_by_dataset_then_structure(spark):
    cols = "paper_id string, structure string, player_num long, text string, rep_num int"
    rows = [("p3", "network-swap", 1, "a", 5), ("p2", "network-swap", 1, "a", 12), ("p0", None, 1, None, 6), ("p0", "thin", None, "a", 6)]
    base = cv.base_messages(spark.createDataFrame(rows, cols), ("p1",), 6, {"p3": 5}, {"network-swap": 12})
    got = {(r["paper_id"], r["structure"]): (r["last_rep"], r["text"]) for r in base.collect()}
    assert got == {("p3", "network-swap"): (5, "a"), ("p2", "network-swap"): (12, "a"), ("p0", None): (6, "")}


def test_turns_are_cut_by_trial(spark):
    cols = "game_id long, paper_id string, target string, structure string, group_size int, stage_num int, rep_num int, trial_num int, message_number int, player_num long, role string, text string"
    rows = [(1, "p0", "A", "thin", 2, 1, 6, t, n, 10, "describer", w) for t, n, w in ((61, 1, "big"), (61, 2, "bird"), (62, 3, "big"))]
    base = cv.base_messages(spark.createDataFrame(rows, cols), (), 6)
    occ = cv.occurrence_per_turn(base, cv.conventions(base))
    got = sorted((r["trial_num"], r["text"], r["same"], r["base_regex"]) for r in occ.collect())
    assert got == [(61, "big bird", True, 0), (62, "big", True, 0)]
    exact = cv.occurrence_per_turn(base, cv.conventions(base), fuzzy=False, role="describer")
    assert "fuzzy_regex" not in exact.columns and exact.count() == 2


def test_earliest_keeps_ties(spark):
    rows = [(1, "A", "p0", "thin", 2, 3, "describer", 10, 1), (1, "A", "p0", "thin", 2, 3, "describer", 11, 1),
            (1, "A", "p0", "thin", 2, 5, "describer", 10, 1), (1, "A", "p0", "thin", 2, 2, "describer", 10, 0)]
    occ = spark.createDataFrame(rows, "game_id long, target string, paper_id string, structure string, group_size int, rep_num int, role string, player_num long, fuzzy_regex int")
    e = cv.earliest(occ, "fuzzy_regex", True)
    assert sorted((r["rep_num"], r["player_num"]) for r in e.collect()) == [(3, 10), (3, 11)]


def test_conventions_concat_in_message_order_and_drop_empty(spark):
    rows = [(1, "p0", "A", "thin", 2, 1, 6, 2, 10, "describer", "Bird!"), (1, "p0", "A", "thin", 2, 1, 6, 1, 10, "describer", "the BIG"),
            (2, "p0", "B", "thin", 2, 1, 6, 1, 20, "describer", "123")]
    base = cv.base_messages(spark.createDataFrame(rows, "game_id long, paper_id string, target string, structure string, group_size int, stage_num int, rep_num int, message_number int, player_num long, role string, text string"), (), 6)
    got = [(r["game_id"], r["convention"]) for r in cv.conventions(base).collect()]
    assert got == [(1, "the big bird")]


def test_first_share_sums_to_one(spark):
    rows = [("thin", 2, r) for r in (1, 1, 2, 8)] + [("thick", 4, 3)]
    e = spark.createDataFrame(rows, "structure string, group_size int, rep_num int")
    s = cv.first_share(e)
    tot = {(r[0], r[1]): r[2] for r in s.groupBy("structure", "group_size").agg(F.sum("share")).collect()}
    assert all(abs(v - 1) < 1e-9 for v in tot.values())
    assert {r["first"] for r in s.collect()} == {"1", "2", "7+", "3"}


def test_flags_equal_dynamic_programming(spark):
    import random

    from tests.approx import fuzzy_contains_reference

    random.seed(5)
    rows = []
    for _ in range(300):
        p = "".join(random.choice("ab ") for _ in range(random.randint(1, 40))).strip() or "a"
        t = "".join(random.choice("ab ") for _ in range(random.randint(0, 60)))
        rows.append((t, p, int(fuzzy_contains_reference(p, t))))
    df = spark.createDataFrame(rows, "text string, convention string, expected int")
    for dedupe in (True, False):
        got = cv._flags(df, dedupe)
        assert got.where(F.col("fuzzy_regex") != F.col("expected")).count() == 0
        assert got.count() == len(rows)


def test_forward_fill_of_a_group_that_spans_tasks(spark):
    """Half of all rows are one group; the fill crosses range borders, long gaps and ties."""
    import random

    rng = random.Random(3)
    rows = [("hot" if k % 2 else (None if k % 10 == 0 else f"g{k % 7}"), k // 3, k, rng.choice([None] * 30 + [1, 2])) for k in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, n int, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        out = cv.locf(df, "v", ["g"], ["at", "n"], "filled")
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["g", "at", "n", "v", "filled"]
    want, last = {}, {}
    for g, at, n, v in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2])):
        last[g] = v if v is not None else last.get(g)
        want[n] = last[g]
    assert {r.n: r.filled for r in got} == want and len(got) == len(rows)
    assert len({r.task for r in got if r.g == "hot"}) > 1
    same = cv.locf(df, "v", ["g"], ["at", "n"], "v")  # in place
    assert same.columns == ["g", "at", "n", "v"] and {r.n: r.v for r in same.collect()} == want
