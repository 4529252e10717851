import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.operators import sets as so
from convoscope.sources import batches as bt


def _members(spark, sizes):
    rng = np.random.default_rng(0)
    rows = []
    for sid, n in enumerate(sizes):
        for i in range(n):
            v = rng.normal(size=8)
            rows.append((sid, i, "comp" if sid % 2 == 0 else "noncomp", [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "set_id long, idx int, set_type string, embedding array<double>")


def test_pair_count_is_n_choose_2(spark):
    sizes = [16, 16, 5, 1]
    p = so.set_pairs(_members(spark, sizes), max_size=16)
    got = {r[0]: r[1] for r in p.groupBy("set_id").count().collect()}
    assert got == {0: 120, 1: 120, 2: 10}


def test_sets_of_any_size(spark):
    p = so.set_pairs(_members(spark, [40, 3]))
    assert {r[0]: r[1] for r in p.groupBy("set_id").count().collect()} == {0: 780, 1: 3}


def test_set_size_guard(spark):
    with pytest.raises(ValueError):
        so.set_pairs(_members(spark, [17]), max_size=16)


@pytest.mark.parametrize("n,draws", [(300, None), (300, 8), (9, 8)])
def test_sampling_equals_brute_force_draws(spark, n, draws):
    items = spark.range(n).select((F.col("id") * 7 % 1009 + 5).alias("item_id")).repartition(3)
    # few draws leave some sets short: they draw on
    got = so.sample_per_set(items, n_sets=20, k=8, seed="s", draws=draws)
    rows = sorted((r["set_id"], r["rank"], r["item_id"]) for r in got.collect())
    ordered = sorted(r["item_id"] for r in items.collect())
    exp = []
    for s in range(20):
        places, j = [], 0
        while len(places) < 8:
            p = int(hashlib.md5(f"s:{s}:{j}".encode()).hexdigest()[:12], 16) % n
            places += [p] if p not in places else []
            j += 1
        exp += [(s, r + 1, ordered[p]) for r, p in enumerate(places)]
    assert rows == sorted(exp)


def test_comp_sets_are_top_x_bottom(spark):
    items = spark.range(1, 101).select(F.col("id").alias("item_id"))
    g = so.gen_sets_comp(items, n_sets=3, set_size=16, seed="x")
    per = g.groupBy("set_id").agg(F.countDistinct("top").alias("t"), F.countDistinct("bottom").alias("b"), F.count("*").alias("n"))
    assert all((r["t"], r["b"], r["n"]) == (4, 4, 16) for r in per.collect())


def test_pending_batches_rerun_partial(spark):
    planned = bt.planned_batches(spark, 60, 25)  # 25, 25, 10
    finished = spark.createDataFrame([(s, s // 25) for s in list(range(25)) + list(range(25, 30))], "set_id long, batch_id int")
    got = sorted(r["batch_id"] for r in bt.pending_batches(planned, finished).collect())
    assert got == [1, 2]


def test_batch_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 0), (1, 2.0, 0), (30, 3.0, 1)], "set_id long, v double, batch_id int")
    root = str(tmp_path / "b")
    bt.write_batches(df, root)
    bt.write_batches(df.where("batch_id = 1"), root)  # rerun of one batch replaces only it
    back = bt.read_batches(spark, root)
    assert back.count() == 3
    assert bt.newest_batch(back).collect()[0][0] == 1


def test_similarities_are_ranked_unrounded(spark):
    """Two pairs that differ beyond the sixth place: the larger comes first, and decides what is kept."""
    rows = [(0, 0, "s", [1.0, 0.0]), (0, 1, "s", [0.5, 0.0]), (0, 2, "s", [0.5 + 2.0**-24, 0.0])]
    rows += [(1, 0, "s", [1.0, 0.0]), (1, 1, "s", [0.5 + 2.0**-23, 0.0])]
    pairs = so.set_pairs(spark.createDataFrame(rows, "set_id long, idx int, set_type string, embedding array<double>"))
    first = so.topk_pairs(pairs, n=1).where("set_id = 0").first()
    assert (first.i, first.j, first.similarity) == (0, 2, 0.5 + 2.0**-24)
    assert {r.set_id: r.kept for r in so.set_select(pairs).collect()} == {0: True, 1: False}
