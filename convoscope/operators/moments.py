"""Centred moments of many columns, per group, from one read.

Spark's ``avg`` and ``covar_pop`` update means and co-moments row by row and merge
partial results pairwise, so no raw sum of squares is ever taken (those cancel when a
mean is large beside its spread).  One aggregate over all columns that any model form
needs serves every form and every fold: a fold's training moments are the merged
moments of the other folds, and its held-out errors follow from its own moments, so
fits, comparisons and predictions take a single pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moment_table(df: DataFrame, columns: Mapping[str, Column], by: Sequence[str | Column] = ()) -> DataFrame:
    """``by``, ``n``, ``m0..`` (means) and ``c_i_j`` (sums of centred products): one row per group.
    Rows with a null in any column are left out, as a fit would."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    named = df.select(*keys, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values())])
    names = named.columns[: len(keys)]
    rows = named.dropna(subset=[f"_x{i}" for i in range(len(columns))])
    n = F.count(F.lit(1))
    means = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(len(columns))]
    cross = [(F.covar_pop(f"_x{i}", f"_x{j}") * n).alias(f"c_{i}_{j}") for i, j in _pairs(len(columns))]
    return rows.groupBy(*names).agg(n.alias("n"), *means, *cross)


@dataclass
class Moments:
    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, names: Iterable[str], row: Row) -> Moments:
        names = list(names)
        k = len(names)
        cross = np.zeros((k, k))
        if row["n"]:
            for i, j in _pairs(k):
                cross[i, j] = cross[j, i] = row[f"c_{i}_{j}"]
        return cls(names, float(row["n"]), np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cross)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        cross = self.cross + other.cross + np.outer(gap, gap) * self.n * other.n / n
        return Moments(self.names, n, self.mean + gap * other.n / n, cross)

    def part(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(x) for x in names]
        return Moments(list(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def squared_error(self, beta: np.ndarray) -> float:
        """Sum of squared errors of the last column, predicted by intercept and slopes of the others."""
        off = self.mean[-1] - beta[0] - beta[1:] @ self.mean[:-1]
        w = np.append(-beta[1:], 1.0)
        return float(max(w @ self.cross @ w, 0.0) + self.n * off * off)


def merge_all(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for p in parts[1:]:
        out = out.merged(p)
    return out


def log_density(n: float, sse: float, sigma2: float) -> float:
    """Summed Gaussian log density of n errors with this sum of squares."""
    return -0.5 * n * math.log(2 * math.pi * sigma2) - sse / (2 * sigma2)
