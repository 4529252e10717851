"""Plan checks on the oracle-checked queries: no cartesian product, no Python
evaluation except where declared, filters and columns pushed to the scan."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_SMALL

# keys whose plan runs Python on purpose (Arrow-batched dense linear algebra)
PYTHON_OK = {"anchor_deflate"}
QS = queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in oracle_sql() if not re.match(r"op\d+_", k)))
def test_no_cartesian_and_no_python(spark, key):
    plan = _plan(QS[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if key not in PYTHON_OK:
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pushdown_and_pruning(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan(QS["hedge_by_rep"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    # each scan reads only the columns its side of the join needs, and the join carries no text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert "source" not in plan and "n_chars" not in plan
    shuffled = [ln for ln in plan.split("\n") if "Project" in ln and "text#" in ln and "AS text" not in ln and "hedge_count" not in ln]
    assert not any("Exchange" in ln for ln in shuffled)


def test_exact_keys_run_no_fuzzy_match(spark):
    for key in ("earliest_any_base", "earliest_describer_base"):
        plan = _plan(QS[key](spark, SF_SMALL))
        assert "levenshtein" not in plan and "Python" not in plan and "events" in plan


def test_token_features_aggregate_before_shuffle(spark):
    plan = _plan(QS["nominal_share"](spark, SF_SMALL))
    assert "partial_count" in plan or "partial_count_if" in plan
