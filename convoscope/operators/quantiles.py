"""Exact quantiles per group in a fixed number of passes, for groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer: a group holding a third of the data would sit in one task's
memory.  Here the wanted ranks are found by *radix selection*.  A double's 64 bits,
with the lower ones of negative numbers flipped, are a long that sorts as the double
does.  A pass counts, per group and per prefix that still holds a wanted rank, the
next 16 bits; running sums of those counts (at most 65,536 rows a prefix) name the
digit that each rank falls on.  Four passes give all bits of all ranks of all groups.
Every pass is one aggregate with map-side partial counts; no row is collected or
sorted, and no number of passes depends on the data.

The passes are one lazy plan over a projection that is written once, so a lost
executor recomputes its part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoscope.operators.joins import join_null_safe

DIGIT = 16
#: Groups whose open prefixes (two per quantile at most) are broadcast to the rows; more are joined by shuffle.
BROADCAST_GROUPS = 20_000


def sortable(v: Column) -> Column:
    """The 64 bits of a double as a long with the same order (-0.0 counts as 0.0, NaN comes last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def unsorted(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _ranks(probs: Mapping[str, float], method: str) -> dict[str, Column]:
    """Wanted 0-based ranks in a group of ``n``, as columns named by quantile and side."""
    n = F.col("n")
    out: dict[str, Column] = {}
    for name, p in probs.items():
        if method == "lower":
            out[f"{name}_lo"] = F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)).cast("long")
        elif method == "linear":
            out[f"{name}_lo"] = F.floor(F.lit(p) * (n - 1)).cast("long")
            out[f"{name}_hi"] = F.ceil(F.lit(p) * (n - 1)).cast("long")
        else:
            raise ValueError(method)
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], method: str = "linear"
) -> DataFrame:
    """One row per group: the keys, ``n`` and a column per entry of ``probs``.

    ``method='linear'``: R type 7 / ``percentile_cont`` (interpolated).
    ``method='lower'``: ``percentile_disc`` -- the smallest value whose
    cumulative share reaches p (for p=0.5 and even n, the lower middle).
    NULL values are ignored; NULL keys form their own group (null-safe joins);
    a group without values has no row; without keys there is always one row.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull()).select(*keys, sortable(v).alias("_key")).checkpoint()
    few = not keys or base.select(*keys).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    wanted = _ranks(probs, method)
    names = list(wanted)

    def found(counts: DataFrame, within: list[str]) -> DataFrame:
        """The digits that hold wanted ranks, and the ranks left to go within each."""
        each = Window.partitionBy(*within).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(each), F.lit(0)))
        here = {r: F.when((F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_c")), F.col(r) - F.col("_before")) for r in names}
        return counts.withColumns(here).where(reduce(lambda a, b: a | b, (F.col(r).isNotNull() for r in names)))

    counts = base.groupBy(*keys, F.shiftright("_key", 64 - DIGIT).alias("_digit")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("n", F.sum("_c").over(Window.partitionBy(*keys))).withColumns(wanted)
    state = found(counts, keys).select(*keys, "n", *names, F.col("_digit").alias("_prefix"))
    for shift in range(64 - 2 * DIGIT, -1, -DIGIT):
        rows = base.select(*keys, F.shiftright("_key", shift + DIGIT).alias("_prefix"), F.shiftright("_key", shift).alias("_next"))
        open_ = F.broadcast(state) if few else state
        rows = join_null_safe(rows, open_, [*keys, "_prefix"])
        digit = F.col("_next").bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = rows.groupBy(*keys, "_prefix", "n", *names, digit.alias("_digit")).agg(F.count("*").alias("_c"))
        prefix = F.shiftleft("_prefix", DIGIT) + F.col("_digit")
        state = found(counts, [*keys, "_prefix"]).select(*keys, "n", *names, prefix.alias("_prefix"))
    state = state.withColumn("_v", unsorted(F.col("_prefix")))
    ends = state.groupBy(*keys).agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), *[F.max(F.when(F.col(r).isNotNull(), F.col("_v"))).alias(r) for r in names])
    out = []
    for name, p in probs.items():
        lo = F.col(f"{name}_lo")
        if method == "linear":
            at = F.lit(p) * (F.col("n") - 1)
            part = at - F.floor(at)
            lo = lo * (1 - part) + F.col(f"{name}_hi") * part
        out.append(lo.alias(name))
    return ends.select(*keys, "n", *out)
