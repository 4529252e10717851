"""Query registry: key -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    key: str
    build: Builder
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, bench: bool = False):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, bench)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills the registry
    from convoscope.plans import (  # noqa: F401
        q_conventions,
        q_features,
        q_models,
        q_sets,
        q_star,
        q_text,
        q_vectors,
    )

    return REGISTRY
