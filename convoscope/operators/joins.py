"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match NULL keys (``<=>``), like dplyr/pandas.

    Spark still plans a hash or sort-merge join on null-safe keys (it joins on
    ``coalesce(k, default), isnull(k)`` pairs).  The key columns appear once in
    the output, taken from the left side (from the right one for right joins,
    from either for full joins).  Keys are renamed on both sides and referenced
    by name, so joining two frames derived from one scan is unambiguous.
    """
    keys = list(keys)
    lk = {k: f"__l_{k}" for k in keys}
    rk = {k: f"__r_{k}" for k in keys}
    lft = left.select(*[F.col(c).alias(lk[c]) if c in lk else F.col(c) for c in left.columns])
    rgt = right.select(*[F.col(c).alias(rk[c]) if c in rk else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(lk[k]).eqNullSafe(F.col(rk[k]))
        cond = c if cond is None else cond & c
    j = lft.join(rgt, cond, how)
    if how in ("left_semi", "semi", "left_anti", "anti"):
        return j.select(*[F.col(lk[c]).alias(c) if c in lk else F.col(c) for c in left.columns])
    if how in ("right", "right_outer"):
        out = [F.col(rk[k]).alias(k) for k in keys]
    elif how in ("full", "full_outer", "outer"):
        out = [F.coalesce(F.col(lk[k]), F.col(rk[k])).alias(k) for k in keys]
    else:
        out = [F.col(lk[k]).alias(k) for k in keys]
    rest_l = [F.col(c) for c in left.columns if c not in lk]
    rest_r = [F.col(c) for c in right.columns if c not in rk]
    return j.select(*out, *rest_l, *rest_r)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast-hint ``df`` only after checking its row count.

    Use for parameter-sized tables whose size is not fixed by construction.
    Beyond the bound the plain frame is returned and the planner (AQE, with its
    runtime size statistics) picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def attach_row(df: DataFrame, one_row: DataFrame, columns=None) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df`` as
    scalar subqueries (evaluated once, no join)."""
    cols = list(columns or one_row.columns)
    packed = one_row.select(F.struct(*cols).alias("r")).scalar()
    # one subquery column, then its fields (the subquery runs once)
    with_row = df.select("*", packed.alias("__row"))
    return with_row.select(*df.columns, *[F.col("__row").getField(c).alias(c) for c in cols])
