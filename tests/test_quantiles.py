import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convoscope.operators import quantiles
from convoscope.operators.quantiles import exact_quantiles


def _data():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, 3000)
    v = rng.normal(size=3000).round(2)  # many ties
    rows = [(int(a), float(b)) for a, b in zip(g, v)] + [(None, 1.0), (None, 2.0), (None, 3.0), (None, 4.0)]
    return rows


def test_linear_and_lower_match_numpy(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "g int, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    for method in ("linear", "lower"):
        res = exact_quantiles(df, ["g"], "v", probs, method=method).toPandas()
        for g, grp in pdf.groupby("g", dropna=False):
            x = np.sort(grp.v.to_numpy())
            r = res[res.g.isna()] if pd.isna(g) else res[res.g == g]
            for name, p in probs.items():
                exp = np.quantile(x, p) if method == "linear" else x[max(int(np.ceil(p * len(x))) - 1, 0)]
                assert abs(r[name].iloc[0] - exp) < 1e-12


def test_lower_vs_interpolated_median_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    lo = exact_quantiles(df, [], "v", {"m": 0.5}, method="lower").collect()[0]["m"]
    li = exact_quantiles(df, [], "v", {"m": 0.5}, method="linear").collect()[0]["m"]
    assert (lo, li) == (2.0, 2.5)


@pytest.mark.parametrize("groups", [20_000, 0])
def test_signs_magnitudes_and_ties(spark, monkeypatch, groups):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", groups)  # 0: prefixes are joined by shuffle
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400), [0.0, -0.0, 5e-324, -5e-324], np.full(200, 1.5)])
    df = spark.createDataFrame([(None if x is None else float(x), "g") for x in [*v, None]], "v double, g string")
    probs = {"p0": 0.0, "p1": 0.01, "p3": 0.3, "p5": 0.5, "p9": 0.9, "p10": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs, method="lower").collect()[0]
    x = np.sort(v)
    assert got["n"] == len(x)
    assert [got[k] for k in probs] == [x[max(int(np.ceil(p * len(x))) - 1, 0)] for p in probs.values()]


def test_hot_group_is_never_gathered(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 0.37 % 911).alias("v"))
    out = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    want = df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m")).collect()
    assert {r.g: round(r.m, 9) for r in out.collect()} == {r.g: round(r.m, 9) for r in want}


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(none, ["g"], "v", {"m": 0.5}).collect() == []
    assert [tuple(r) for r in exact_quantiles(none, [], "v", {"m": 0.5}).collect()] == [(0, None)]
