"""Varying intercepts and slopes on nested levels (paper / condition / game).

    y = x (b + u_paper + v_condition + w_game) + e

with a full covariance matrix per level.  The groups are a tree, and given the
covariances everything is Gaussian, so the estimates need no design matrix:

* one pass over the rows gives each innermost group its Gram block (from centred,
  mergeable moments around one reference point);
* upward, a group's information (precision and precision-weighted sum) is weakened by
  the spread of its level, M = (1 + A S)^-1, and summed into the group above; the
  root's sum gives the coefficients common to all;
* downward, every group's deviation from the group above and its uncertainty follow;
* the expected squares of deviations and residuals are the next covariances (EM).

After the first pass only group rows move: per round one grouped sum per level, a join
from each level to the next, and a few numbers to the driver.  A group with a third of
all rows is one group row; a condition with a third of all games is a partially
aggregated sum, and its estimate is broadcast to its games while the conditions are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoscope.operators.joins import join_null_safe
from convoscope.operators.moments import moment_table

#: Groups of a level that are broadcast to the level below; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


@dataclass
class Nested:
    terms: list[str]  # intercept first
    levels: list[str]
    centre: np.ndarray  # of the terms and the response; the intercept is the mean there
    beta: np.ndarray
    beta_cov: np.ndarray
    spread: list[np.ndarray]  # covariance of deviations per level, outermost first
    sigma2: float
    estimates: list[DataFrame]  # per level: its keys, n, b0..bp


def _names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def _square(pdf: pd.DataFrame, prefix: str, p: int) -> np.ndarray:
    return pdf[_names(prefix, p * p)].to_numpy(float).reshape(-1, p, p)


def _mapped(df: DataFrame, keys: Sequence[str], out: Sequence[str], fn: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Keys, and the double columns ``out`` that ``fn`` computes for a batch of group rows."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} double" for c in out)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(fn(pdf), columns=list(out), index=pdf.index)
            yield pd.concat([pdf[list(keys)], found], axis=1)

    return df.mapInPandas(run, schema)


def _sums(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def fit(
    df: DataFrame, levels: Sequence[str], terms: Mapping[str, Column], y: Column, rounds: int = 10
) -> Nested:
    """``levels`` outermost first; a group is named by its level's column and those above it.

    Null level values are groups of their own; rows with a null term or response are left
    out; no rows raise; groups of a single row are kept and take most from the group above."""
    levels = list(levels)
    columns = {**terms, "_y": y}
    p = len(terms) + 1
    J, H, B, V, D = _names("j", p * p), _names("h", p), _names("b", p), _names("v", p * p), _names("d", p * p)
    table = moment_table(df, columns, levels).checkpoint()  # the only pass over the rows
    k = len(columns)
    total = table.agg(
        F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(k)]
    ).first()
    if not total["n"]:
        raise ValueError("no rows to fit")
    rows, centre = float(total["n"]), np.array([total[f"m{i}"] for i in range(k)])

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        """X'X, X'y and y'y of a group around the reference point, intercept first."""
        n = pdf["n"].to_numpy(float)
        gap = pdf[[f"m{i}" for i in range(k)]].to_numpy(float) - centre
        cross = np.empty((len(pdf), k, k))
        for i in range(k):
            for j in range(i, k):
                cross[:, i, j] = cross[:, j, i] = pdf[f"c_{i}_{j}"] + n * gap[:, i] * gap[:, j]
        full = np.empty((len(pdf), p, p))
        full[:, 0, 0] = n
        full[:, 0, 1:] = full[:, 1:, 0] = n[:, None] * gap[:, :-1]
        full[:, 1:, 1:] = cross[:, :-1, :-1]
        xy = np.concatenate([(n * gap[:, -1])[:, None], cross[:, :-1, -1]], axis=1)
        return np.concatenate([full.reshape(-1, p * p), xy, cross[:, -1, -1:], n[:, None]], axis=1)

    games = _mapped(table, levels, [*J, *H, "yy", "n"], gram).checkpoint()
    # start: least squares without groups, and a quarter of the response's spread on every level
    first = games.agg(*[F.sum(c).alias(c) for c in [*J, *H, "yy"]]).first()
    g0, h0 = np.array([first[c] for c in J]).reshape(p, p), np.array([first[c] for c in H])
    if np.linalg.cond(g0 / np.sqrt(np.outer(np.diag(g0), np.diag(g0)))) > 1e12:
        raise ValueError(f"the terms {list(terms)} are not of full rank in {int(rows)} rows")
    beta = np.linalg.solve(g0, h0)
    sigma2 = max(float(first["yy"] - beta @ h0) / max(rows - p, 1.0), 1e-12)
    spread = [np.diag(sigma2 / np.diag(g0) * rows) / 4 for _ in levels]
    within = [levels[: i + 1] for i in range(len(levels))]
    small = [games.select(*keys).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS for keys in within[:-1]]
    eye = np.eye(p)

    def upward(spread: list[np.ndarray], sigma2: float) -> tuple[list[DataFrame], np.ndarray, np.ndarray]:
        """Per level the information from below (innermost: the scaled Gram blocks), and the root's."""
        scaled = games.select(*levels, "n", "yy", *[(F.col(c) / F.lit(sigma2)).alias(c) for c in [*J, *H]])
        held = [scaled]
        for i in range(len(levels) - 1, -1, -1):
            def weakened(pdf: pd.DataFrame, s=spread[i]) -> np.ndarray:
                a, h = _square(pdf, "j", p), pdf[H].to_numpy(float)
                m = np.linalg.inv(eye + a @ s)
                return np.concatenate([(m @ a).reshape(-1, p * p), (m @ h[:, :, None])[:, :, 0]], axis=1)

            up = _mapped(held[0], within[i][:-1], [*J, *H], weakened)
            held.insert(0, _sums(up, within[i][:-1], [*J, *H]))
            if i:
                held[0] = held[0].checkpoint()
        root = held[0].first()
        return held[1:], np.array([root[c] for c in J]).reshape(p, p), np.array([root[c] for c in H])

    def downward(held: list[DataFrame], spread: list[np.ndarray], beta: np.ndarray, cov: np.ndarray) -> list[DataFrame]:
        """Per level: keys, mean b and covariance v of each group's coefficients, expected square d of its deviation."""
        out: list[DataFrame] = []
        for i, below in enumerate(held):
            if i:
                above = out[-1].select(*within[i - 1], *B, *V)
                below = join_null_safe(below, F.broadcast(above) if small[i - 1] else above, within[i - 1])

            def estimated(pdf: pd.DataFrame, s=spread[i], top=i == 0) -> np.ndarray:
                a, h = _square(pdf, "j", p), pdf[H].to_numpy(float)
                mean = np.broadcast_to(beta, h.shape) if top else pdf[B].to_numpy(float)
                c = np.broadcast_to(cov, a.shape) if top else _square(pdf, "v", p)
                d = s @ np.linalg.inv(eye + a @ s)
                off = (d @ (h - (a @ mean[:, :, None])[:, :, 0])[:, :, None])[:, :, 0]
                pull = d @ a
                square = d + pull @ c @ pull.transpose(0, 2, 1) + off[:, :, None] * off[:, None, :]
                rest = eye - pull
                theta, v = mean + off, rest @ c @ rest.transpose(0, 2, 1) + d
                cols = [theta, v.reshape(-1, p * p), square.reshape(-1, p * p)]
                if "yy" in pdf:  # expected squared residuals of the group's rows
                    raw = a * sigma2
                    fit_ = (theta[:, :, None] * raw * theta[:, None, :]).sum(axis=(1, 2))
                    cols.append((pdf["yy"].to_numpy(float) - 2 * sigma2 * (h * theta).sum(axis=1) + fit_ + (raw * v).sum(axis=(1, 2)))[:, None])
                    cols.append(pdf[["n"]].to_numpy(float))
                return np.concatenate(cols, axis=1)

            extra = ["sse", "n"] if i == len(held) - 1 else []
            out.append(_mapped(below, within[i], [*B, *V, *D, *extra], estimated))
        return out

    for _ in range(rounds):
        held, a, h = upward(spread, sigma2)
        cov = np.linalg.inv(a)
        beta = cov @ h
        levels_ = downward(held, spread, beta, cov)
        parts = [
            x.agg(F.lit(i).alias("level"), F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in D], (F.sum("sse") if "sse" in x.columns else F.lit(None).cast("double")).alias("sse"))
            for i, x in enumerate(levels_)
        ]
        for r in reduce(DataFrame.unionByName, parts).collect():  # a row per level
            spread[r.level] = np.array([r[c] for c in D]).reshape(p, p) / r.groups
            if r.sse is not None:
                next_sigma2 = max(r.sse / rows, 1e-12)
        sigma2 = next_sigma2
    held, a, h = upward(spread, sigma2)
    cov = np.linalg.inv(a)
    beta = cov @ h
    counts = [games.groupBy(*keys).agg(F.sum("n").cast("long").alias("n")) for keys in within]
    found = [x.select(*keys, *B) for keys, x in zip(within, downward(held, spread, beta, cov), strict=True)]
    estimates = [join_null_safe(c, x, keys) for c, x, keys in zip(counts, found, within, strict=True)]
    return Nested(["intercept", *terms], levels, centre, beta, cov, spread, sigma2, estimates)


def coefficients(model: Nested) -> DataFrame:
    """level, its keys (null above their level), n, and one column per term: the shrunk coefficients of
    every group, and those common to all (level ``all``).  The intercept is the prediction at 0."""
    at = model.centre[:-1]
    p = len(model.terms)
    intercept = F.col("b0") + F.lit(float(model.centre[-1])) - sum((F.col(f"b{i + 1}") * F.lit(float(c)) for i, c in enumerate(at)), F.lit(0.0))
    types = {f.name: f.dataType for f in model.estimates[-1].schema}
    parts = []
    for i, df in enumerate(model.estimates):
        keys = [(F.col(k) if j <= i else F.lit(None).cast(types[k])).alias(k) for j, k in enumerate(model.levels)]
        parts.append(df.select(F.lit(model.levels[i]).alias("level"), *keys, "n", intercept.alias("intercept"), *[F.col(f"b{j}").alias(model.terms[j]) for j in range(1, p)]))
    root = model.estimates[0].agg(F.sum("n").alias("n"))
    root = root.select("n", *[F.lit(float(b)).alias(f"b{i}") for i, b in enumerate(model.beta)])
    keys = [F.lit(None).cast(types[k]).alias(k) for k in model.levels]
    parts.append(root.select(F.lit("all").alias("level"), *keys, "n", intercept.alias("intercept"), *[F.col(f"b{j}").alias(model.terms[j]) for j in range(1, p)]))
    return reduce(DataFrame.unionByName, parts)
