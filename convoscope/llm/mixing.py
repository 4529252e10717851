"""Mixing sources to target weights by systematic sampling.

Targets: sources in code point order (null last) take the weights in turn and
share all words; a source stops at ``cap`` times its size and its excess goes
to the others by weight until none is above.

Sampling: every document of a source expects target / size copies.  Expected
copies are fixed-point integers, so their prefix sums are exact and don't
depend on the order in which Spark adds.  A source's documents run in blocks of
a bounded number of rows, by size within a block; each block starts where the
one before ended, one random offset per source is added, and a document is
emitted once per whole number that its stretch crosses.  A hot source is many
blocks, never one task's list.  A row's block is drawn from its id, or from its
text where the id is missing; within a block equal sizes go by id, then by the
text's hash, so that a rerun draws the same rows.

Defined results: a null text has size 0; a source of size 0 has target 0 and
nothing taken; a null doc_id is drawn like any other; rows that repeat are
drawn each; no rows give no rows; other columns pass through (mix: but for those named like a result).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoscope.llm.tables import stored
from convoscope.operators.numbering import numbered

BLOCK_ROWS = 1_000
BLOCKS_A_GROUP = 1_000
UNIT_BITS = 24
BLANKS = "[ \\t-\\r]+"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def draw(*parts: Column) -> Column:
    """A number below 2**24 from the parts, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 6), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes(source, source_size, documents) -> with weight and target (words)."""
    order = (F.col("source").isNull().asc(), F.col("source").asc())
    turn = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(numbered(sizes, *order).withColumn("weight", turn).drop("place"), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, before = None, None
    most = F.col("source_size") * cap
    while level is None or level != before:  # the level only rises, and stays once no source passes its cap
        before = level
        full = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        held, rest = table.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if not rest:
            level = before or 0.0
            break
        level = float(total - held) / float(rest)
    target = F.least(most.cast("double"), F.lit(float(level)) * F.col("weight"))
    return table.withColumn("target", target)


def _drawn(docs: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """docs(doc_id, text, source, ...) -> row (its columns), size, source_size, target, copies."""
    own = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), own.alias("_own"), F.struct("*").alias("row"))
    slim = stored(sized.drop("row"), "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = source_targets(sources, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.floor(rate * (1 << UNIT_BITS)).cast("long").alias("_each"),
        F.ceil(F.col("documents") / BLOCK_ROWS).cast("long").alias("_blocks"),
        draw(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).alias("_offset"),
    )
    sources = stored(sources, "targets")

    def placed(df: DataFrame) -> DataFrame:
        found = df.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        block = draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("_own"))) % F.col("_blocks")
        return found.withColumn("_block", block).drop("_source", "_blocks")

    # where each block starts: blocks in groups, groups in their source
    sums = placed(slim).groupBy("source", "_block").agg(F.sum("_each").alias("_sum"))
    sums = stored(sums.withColumn("_group", F.floor(F.col("_block") / BLOCKS_A_GROUP)), "blocks")
    so_far = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select(
        F.col("source").alias("_g_source"),
        F.col("_group").alias("_g_group"),
        F.coalesce(F.sum("_sum").over(so_far("source", "_group")), F.lit(0)).alias("_before_group"),
    )
    inner = F.coalesce(F.sum("_sum").over(so_far("source", "_group", "_block")), F.lit(0))
    starts = sums.withColumn("_inner", inner).join(
        groups, F.col("source").eqNullSafe(F.col("_g_source")) & (F.col("_group") == F.col("_g_group"))
    )
    starts = stored(
        starts.select(
            F.col("source").alias("_s_source"),
            F.col("_block").alias("_s_block"),
            (F.col("_inner") + F.col("_before_group")).alias("_start"),
        ),
        "starts",
    )
    # sizes rise in one block and fall in the next, so that what is drawn stays near the expected words throughout
    swing = F.when(F.col("_block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    run = Window.partitionBy("source", "_block").orderBy(swing, "doc_id", "_own").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(sized).withColumn("_end", F.sum("_each").over(run))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s_source")) & (F.col("_block") == F.col("_s_block")))
    end = F.col("_start") + F.col("_offset") + F.col("_end")
    copies = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("_each"), UNIT_BITS)
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def _own(docs: DataFrame, *added: str) -> list[Column]:
    """docs' columns out of ``row``, but for those that give way to a result of the same name."""
    return [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) -> its rows with size, source_size, target, copies."""
    added = ("size", "source_size", "target", "copies")
    return _drawn(docs, weights, cap, seed).select(*_own(docs, *added), *added)


def emitted(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: docs' rows once per copy, with ``copy`` (from 1)."""
    rows = _drawn(docs, weights, cap, seed).where("copies > 0")
    return rows.select(*_own(docs, "copy"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
