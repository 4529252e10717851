"""Generated item sets: sampling, pairwise similarity inside a set, ranking,
per-set summaries, keep/reject selection, batches.

A set's members and pairs are one task's work, as its size is a parameter of
how sets are generated; ``check_set_sizes`` enforces a bound where the caller
names one.  Similarities are ranked, compared and returned unrounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoscope.functions.vectors import dot
from convoscope.operators.joins import broadcast_if_small
from convoscope.operators.numbering import numbered
from convoscope.operators.quantiles import exact_quantiles


def check_set_sizes(members: DataFrame, max_size: int, set_col: str = "set_id") -> None:
    """Raise if a set has more members than the caller allows."""
    big = members.groupBy(set_col).count().where(F.col("count") > max_size)
    if big.limit(1).count():
        raise ValueError(f"a set has more than {max_size} members; pairs would not be bounded")


def set_pairs(members: DataFrame, max_size: int | None = None, key: str = "idx", vec: str = "embedding") -> DataFrame:
    """All unordered pairs i<j within each set with their dot-product similarity
    (vectors are used as given, like a plain matrix product).

    Sets may have any size; a caller who wants a bound passes ``max_size``.  The
    members of a set meet by one shuffle and one scan: a set is gathered once
    and each member is laid beside the later ones."""
    if max_size is not None:
        check_set_sizes(members, max_size)
    gathered = members.groupBy("set_id", "set_type").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v")))).alias("m"))
    first = gathered.select("set_id", "set_type", "m", F.posexplode("m").alias("at", "a"))
    later = F.slice("m", F.col("at") + 2, F.size("m"))
    p = first.select("set_id", "set_type", "a", F.explode(later).alias("b")).where("a.k < b.k")
    return p.select(
        "set_id", "set_type", F.col("a.k").alias("i"), F.col("b.k").alias("j"), dot("a.v", "b.v").alias("similarity")
    )


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Rank within a set by similarity (descending and ascending), ties by (i, j)."""
    wd = Window.partitionBy("set_id").orderBy(F.desc("similarity"), "i", "j")
    wa = Window.partitionBy("set_id").orderBy(F.asc("similarity"), "i", "j")
    return pairs.select("*", F.row_number().over(wd).alias("rank_desc"), F.row_number().over(wa).alias("rank_asc"))


def topk_pairs(pairs: DataFrame, n: int = 2, reverse: bool = False) -> DataFrame:
    """First n pairs per set (most similar, or least with ``reverse``)."""
    order = F.asc("similarity") if reverse else F.desc("similarity")
    w = Window.partitionBy("set_id").orderBy(order, "i", "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def topk_pairs_mirrored(
    members: DataFrame, n: int = 2, key: str = "idx", vec: str = "embedding", max_size: int | None = None
) -> DataFrame:
    """The k largest entries of the full similarity matrix minus the identity:
    every pair appears as (i, j) and (j, i), and the diagonal enters with its
    self-similarity minus 1.  (``topk_pairs`` is the de-duplicated form.)"""
    pairs = set_pairs(members, max_size, key=key, vec=vec)
    swapped = pairs.select("set_id", "set_type", F.col("j").alias("i"), F.col("i").alias("j"), "similarity")
    diag = members.select(
        "set_id", "set_type", F.col(key).alias("i"), F.col(key).alias("j"), (dot(vec, vec) - 1).alias("similarity")
    )
    full = pairs.unionByName(swapped).unionByName(diag)
    w = Window.partitionBy("set_id").orderBy(F.desc("similarity"), "i", "j")
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pair_lookup(pairs: DataFrame, set_id: int, i: int, j: int) -> DataFrame:
    lo, hi = min(i, j), max(i, j)
    return pairs.where((F.col("set_id") == set_id) & (F.col("i") == lo) & (F.col("j") == hi))


def set_summary(pairs: DataFrame) -> DataFrame:
    """Mean/min/max and the lower median of a set's pair similarities.  A set's
    pairs are bounded (see ``check_set_sizes``), so one exact aggregate per set."""
    return pairs.groupBy("set_id", "set_type").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("similarity").alias("mean_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY similarity)").alias("median_similarity"),
    )


def global_pair_median(pairs: DataFrame) -> DataFrame:
    """Lower median over all pairs of each set type -- an unbounded group, so
    the distributed exact quantile."""
    q = exact_quantiles(pairs, ["set_type"], "similarity", {"median_similarity": 0.5}, method="lower")
    return q.select("set_type", F.col("n").alias("n_pairs"), "median_similarity")


def set_maxima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("set_id", "set_type").agg(F.max("similarity").alias("max_similarity"))


def set_select(pairs: DataFrame) -> DataFrame:
    """Keep a set when its max similarity is below the (interpolated) median of
    the maxima of its set type."""
    mx = set_maxima(pairs)
    med = exact_quantiles(mx, ["set_type"], "max_similarity", {"median_max": 0.5}, method="linear")
    # one row a set type, written before it is counted and broadcast: nothing runs twice
    med = broadcast_if_small(med.select("set_type", "median_max").checkpoint())
    j = mx.join(med, "set_type")
    return j.withColumn("kept", F.col("max_similarity") < F.col("median_max"))


def kept_stats(selected: DataFrame) -> DataFrame:
    k = F.when(F.col("kept"), F.col("max_similarity"))
    return selected.groupBy("set_type").agg(
        F.count_if(F.col("kept")).alias("n_kept"),
        F.count_if(~F.col("kept")).alias("n_rejected"),
        F.avg(k).alias("mean_kept_max"),
        F.min(k).alias("min_kept_max"),
        F.max(k).alias("max_kept_max"),
    )


def histogram(df: DataFrame, value: str, group: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins between the group's min and max, the last bin
    closed; empty bins reported with 0."""
    rng = broadcast_if_small(df.groupBy(group).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax")).checkpoint())
    w = (F.col("vmax") - F.col("vmin")) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("vmin")) / w), F.lit(bins - 1)))
    counted = df.join(rng, group).select(group, b.cast("int").alias("bin")).groupBy(group, "bin").agg(
        F.count(F.lit(1)).alias("count")
    )
    grid = rng.select(group, "vmin", "vmax", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, [group, "bin"], "left")
    ww = (F.col("vmax") - F.col("vmin")) / F.lit(float(bins))
    return out.select(
        group, "bin",
        (F.col("vmin") + F.col("bin") * ww).alias("lo"),
        (F.col("vmin") + (F.col("bin") + 1) * ww).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def hash_key(seed: str, *cols) -> F.Column:
    """Portable pseudo-random order: md5 of ``seed:col1:col2...``."""
    parts = [F.lit(seed)]
    for c in cols:
        parts += [F.lit(":"), c.cast("string")]
    return F.md5(F.concat(*parts))


def sample_per_set(items: DataFrame, n_sets: int, k: int, seed: str, item: str = "item_id", draws: int | None = None) -> DataFrame:
    """For each set 0..n_sets-1, k different items in random order: a repeatable
    sample without replacement.

    Items are numbered once; each set draws positions ``md5(seed:set:draw) mod
    n`` and keeps the first k different ones, so n_sets x draws small rows are
    made and joined to the items by position.  Sets with fewer than k different
    positions draw on."""
    places = numbered(items.select(item), item)
    n_items = places.count()
    if n_items < k:
        raise ValueError(f"cannot sample {k} of {n_items} items without replacement")
    draws = draws or 4 * k
    sets = items.sparkSession.range(n_sets).select(F.col("id").cast("int").alias("set_id"))
    drawn: DataFrame | None = None
    first = 0
    while True:
        at = sets.select("set_id", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))).alias("draw"))
        place = F.conv(F.substring(hash_key(seed, F.col("set_id"), F.col("draw")), 1, 12), 16, 10).cast("long") % n_items
        new = at.select("set_id", place.alias("place"), "draw")
        drawn = new if drawn is None else drawn.unionByName(new)
        drawn = drawn.groupBy("set_id", "place").agg(F.min("draw").alias("draw")).checkpoint()  # a few rows per set
        short = drawn.groupBy("set_id").count().where(F.col("count") < k).select("set_id").checkpoint()
        if short.isEmpty():
            break
        sets, first, draws = short, first + draws, draws * 2
    w = Window.partitionBy("set_id").orderBy("draw")
    ranked = drawn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(places, "place").select("set_id", item, "rank")


def gen_sets_comp(items: DataFrame, n_sets: int, set_size: int = 16, seed: str = "42comp", item: str = "item_id") -> DataFrame:
    """Compositional sets: sample 2q items (q = isqrt(set_size)); the first q
    are tops, the last q bottoms; members are all top x bottom combinations."""
    q = math.isqrt(set_size)
    s = sample_per_set(items, n_sets, 2 * q, seed, item)
    tops = s.where(F.col("rank") <= q).select("set_id", F.col(item).alias("top"), F.col("rank").alias("ti"))
    bottoms = s.where(F.col("rank") > q).select("set_id", F.col(item).alias("bottom"), (F.col("rank") - q).alias("bi"))
    # q x q pairs per set: bounded by the parameter, an equi-join on set_id
    m = tops.join(bottoms, "set_id")
    return m.select(
        "set_id",
        ((F.col("ti") - 1) * q + (F.col("bi") - 1)).cast("int").alias("idx"),
        "top", "bottom",
        F.concat(F.col("top").cast("string"), F.lit("_"), F.col("bottom").cast("string"), F.lit(".png")).alias("image"),
    )


def gen_sets_noncomp(items: DataFrame, n_sets: int, set_size: int = 16, seed: str = "42noncomp", item: str = "item_id") -> DataFrame:
    """Non-compositional sets: sample 2n items; top i pairs with bottom i."""
    s = sample_per_set(items, n_sets, 2 * set_size, seed, item)
    tops = s.where(F.col("rank") <= set_size).select("set_id", F.col(item).alias("top"), F.col("rank").alias("pos"))
    bottoms = s.where(F.col("rank") > set_size).select(
        "set_id", F.col(item).alias("bottom"), (F.col("rank") - set_size).alias("pos")
    )
    m = tops.join(bottoms, ["set_id", "pos"])
    return m.select(
        "set_id", (F.col("pos") - 1).cast("int").alias("idx"), "top", "bottom",
        F.concat(F.col("top").cast("string"), F.lit("_"), F.col("bottom").cast("string"), F.lit(".png")).alias("image"),
    )


def sample_sets(selected: DataFrame, n: int = 10, seed: str = "42") -> DataFrame:
    """n kept sets per set type in hash order (a repeatable uniform sample)."""
    k = selected.where(F.col("kept")).withColumn("h", hash_key(seed, F.col("set_id")))
    w = Window.partitionBy("set_type").orderBy("h", "set_id")
    return k.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("set_type", "set_id", "rank")


def batch_of(set_id, batch_size: int) -> F.Column:
    c = F.col(set_id) if isinstance(set_id, str) else set_id
    return F.floor(c / F.lit(batch_size)).cast("int")
