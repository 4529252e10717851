"""The fixture views read every row of their table: nothing is cut."""

import pytest
from pyspark.sql import functions as F

from convoscope.plans import fixtures as fx
from convoscope.sources.tables import table
from tests.conftest import SF_SMALL


@pytest.mark.parametrize(
    "view,source,kept",
    [
        ("rounds_f", "events", None),
        ("docs_f", "documents", None),
        ("messages_f", "conversations", None),
        ("sets_f", "embeddings", None),
        ("shapes_f", "part", None),
        ("choices_f", "conversations", "role = 'assistant'"),  # a choice is an answer
    ],
)
def test_views_keep_all_rows(spark, view, source, kept):
    rows = table(spark, SF_SMALL, source)
    assert fx.BUILDERS[view](spark, SF_SMALL).count() == (rows.where(kept) if kept else rows).count()


@pytest.mark.parametrize("view,column", [("docs_f", "text"), ("messages_f", "text"), ("rounds_f", "player_num"), ("docs_f", "rep_num")])
def test_views_null_nothing(spark, view, column):
    assert fx.BUILDERS[view](spark, SF_SMALL).where(F.col(column).isNull()).count() == 0


def test_rounds_go_beyond_six(spark):
    most = {r[0]: r[1] for r in fx.rounds_f(spark, SF_SMALL).groupBy("structure").agg(F.max("rep_num")).collect()}
    assert most["network-swap"] >= 12 and most["thin"] >= 6
