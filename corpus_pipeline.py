"""Pipeline over ``documents``: toxicity, near-duplicates, benchmark overlap, secrets, mix.

Every stage takes what its predecessor kept, decides on all of it, and returns
the columns of ``documents`` (the last one adds ``copy``):

* toxicity: documents that score 0.7 or more go; lexicon and weights are fitted on
  the labelled documents that reach the stage;
* near_duplicates: one document of each group with five-word shingles at a
  similarity of 0.8 or more stays, the one with the smallest id;
* decontamination: documents that overlap with a benchmark item go;
* secrets: every finding in a text is masked and ``n_chars`` brought up to date;
* mix: sources are drawn to target weights, a row per copy.

Clean documents pass the filtering stages unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from convoscope.llm import decontaminate, minhash, mixing, secret_ledger, toxicity
from convoscope.llm.tables import stored
from convoscope.session import ensure_checkpoint_dir, shared_path, ship_package
from convoscope.sources.tables import table


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return minhash.without_near_duplicates(docs, percent=80, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return secret_ledger.redacted(docs, shared_path(spark, "llm", f"secret-ledger-{uuid.uuid4().hex}"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.emitted(docs, weights=(5, 2, 1), cap=3)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: SQL can't express the fitted toxicity model; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
