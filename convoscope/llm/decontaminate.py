"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, lower-cased.  Each fixed mask picks four
words out of its span and ignores the ones between; the hash of the picked words
at every position of every document is looked up among the benchmark's.  A hit
fixes how document and item lie side by side.  Wherever enough hits agree on
that, every window of ``window`` words (the whole item, if shorter) is compared
word by word, and an overlap is confirmed if at least ``percent`` of the window's
words are equal (never fewer than seven, or all of a shorter item): substitutions
don't hide a passage, and a shared phrase of a few words doesn't count as one.

No window is lost: ``least_hits`` counts how many hits any window with the needed
equal words has wherever its differing words stand (six for 11 of 13), and only
placements with fewer hits are left uncompared.

Equal items are compared once.  Items are cut into segments and documents into
blocks of bounded size that overlap by a segment, so a comparison never holds a
whole text and the hits of a document are never gathered.

The benchmark's seeds are broadcast only below ``BROADCAST_SEEDS``; a larger
benchmark is joined by shuffle, from the same expressions.

Defined results: null and empty texts overlap with nothing; items of fewer than
four words are too short to be evidence and match nothing, items shorter than
the window are compared whole; null ids are reported as they are; rows that
repeat overlap alike and give one result per id; empty tables give no rows;
columns other than the ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoscope.llm.tables import stored

#: 1: the word counts, 0: it may differ (fixed values).
MASKS = ("1111", "110101", "1011001")
SPAN = max(len(m) for m in MASKS)
WINDOW, PERCENT = 13, 80
#: Window beginnings in a segment of an item, and words in a block of a document.
SEGMENT, BLOCK = 64, 256
#: Seeds of 8-byte hash, item, place and span: about 64 MB in a broadcast table at most.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, codes: str, *keep: str) -> DataFrame:
    """``keep``, ``place`` (from 0), ``span`` and ``seed``: one row per position and mask that fits there.

    Only what is kept travels with the positions, never the text's array."""
    c = F.col(codes)
    shifted = [F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))).alias(f"w{k}") for k in range(SPAN)]
    at = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("place", "near"))
    picked = []
    for k, mask in enumerate(MASKS):
        cols = [F.col(f"near.w{j}") for j, bit in enumerate(mask) if bit == "1"]
        # a mask that runs past the end of the text has a null word there
        seed = F.when(cols[-1].isNotNull(), F.xxhash64(F.lit(k), *cols))
        picked.append(F.struct(F.lit(len(mask)).alias("span"), seed.alias("seed")))
    return at.select(*keep, "place", F.inline(F.array(*picked))).where("seed IS NOT NULL")


def needed_words(size: int, percent: int) -> int:
    """The least number of equal words in a window; windows of a few words allow no difference."""
    return max(-(-size * percent // 100), min(size, 7))


def least_hits(size: int, needed: int) -> int:
    """The fewest hits of the masks in a window of ``size`` words of which ``needed`` are equal, over all places of the others."""
    fewest = {((), 0): 0}  # (the last words: equal or not, words that differ) -> hits
    for _ in range(size):
        after: dict[tuple, int] = {}
        for (last, gone), hits in fewest.items():
            for same in (True, False):
                if gone + (not same) > size - needed:
                    continue
                now = (*last, same)[-SPAN:]
                new = sum(len(now) >= len(m) and all(now[len(now) - len(m) + j] for j, bit in enumerate(m) if bit == "1") for m in MASKS)
                key = (now, gone + (not same))
                after[key] = min(after.get(key, hits + new), hits + new)
        fewest = after
    return min(fewest.values())


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) x benchmark(item_id, text) -> doc_id, item_id, matched, compared, hits:
    the best window's equal words and size, and the number of seed hits inside confirmed windows."""
    text = F.col("text").cast("string")
    named = benchmark.select("item_id", hashes(text).alias("item")).where(F.size("item") >= 4)
    named = stored(named.withColumn("key", F.xxhash64("item")), "items")
    size = F.least(F.size("item"), F.lit(window))
    by_size = [needed_words(n, percent) for n in range(1, window + 1)]
    fewest = [max(1, least_hits(n, m)) if n >= 4 else 1 for n, m in enumerate(by_size, 1)]
    one = named.dropDuplicates(["key"]).withColumn("size", size)
    one = one.withColumn("fewest", F.element_at(F.array(*map(F.lit, fewest)), F.col("size")))

    # segments of the items: SEGMENT window beginnings, with the words that their windows reach
    cut = F.sequence(F.lit(0), F.size("item") - F.col("size"), F.lit(SEGMENT))
    needed = F.element_at(F.array(*map(F.lit, by_size)), F.col("size"))
    segments = one.select("key", "item", "size", needed.alias("needed"), F.explode(cut).alias("low"))
    part = F.slice("item", F.col("low") + 1, F.least(F.col("size") + SEGMENT - 1, F.size("item") - F.col("low")))
    segments = stored(segments.select("key", "low", "size", "needed", part.alias("part")), "segments")

    looked_up = stored(seeds(one.withColumn("last", F.size("item") - F.col("size")), "item", "key", "size", "fewest", "last"), "seeds")
    if looked_up.count() <= BROADCAST_SEEDS:
        looked_up = F.broadcast(looked_up)
    rows = docs.select("doc_id", hashes(text).alias("codes"), F.xxhash64("doc_id", text).alias("row"))
    found = seeds(rows.select("row", "codes"), "codes", "row").withColumnRenamed("place", "begin").drop("span").join(looked_up, "seed")
    found = found.select("row", "key", "size", "fewest", "last", "span", "place", (F.col("begin") - F.col("place")).alias("shift"))
    # a set, as rows that repeat hit alike; it is bounded by the item's words
    placed = found.groupBy("row", "key", "shift", "size", "fewest", "last").agg(F.collect_set(F.struct("place", "span")).alias("at"))
    placed = placed.where(F.size("at") >= F.col("fewest"))
    # the segments in which windows around a hit begin
    lows = F.transform(
        "at",
        lambda h: F.sequence(
            F.floor(F.greatest(F.lit(0), h.place + h.span - F.col("size")) / SEGMENT), F.floor(F.least(h.place, F.col("last")) / SEGMENT)
        ),
    )
    placed = placed.withColumn("low", F.explode(F.array_distinct(F.flatten(lows)))).withColumn("low", (F.col("low") * SEGMENT).cast("int"))
    first = F.col("shift") + F.col("low")  # where the segment lies in the document; it may begin before it
    placed = placed.select("row", "key", "shift", "low", "at", first.alias("first"), F.floor(F.greatest(first, F.lit(0)) / BLOCK).cast("int").alias("block"))
    placed = stored(placed, "placed")

    # blocks of the documents that have a placement, each with the words that a segment beginning in it reaches
    reach = BLOCK + SEGMENT + window
    wanted = placed.select("row").distinct()
    blocks = rows.where(F.size("codes") > 0).join(wanted, "row", "left_semi")
    blocks = blocks.select("row", "doc_id", "codes", F.explode(F.sequence(F.lit(0), F.size("codes") - 1, F.lit(BLOCK))).alias("from"))
    blocks = blocks.select("row", "doc_id", (F.col("from") / BLOCK).cast("int").alias("block"), F.slice("codes", F.col("from") + 1, reach).alias("codes"))
    pairs = placed.join(blocks.dropDuplicates(["row", "block"]), ["row", "block"]).join(segments, ["key", "low"])

    inset = F.col("first") - F.col("block") * BLOCK  # of the segment in the block; below 0 only in the first block
    equal = F.transform("part", lambda w, j: F.when(inset + j >= 0, F.get("codes", inset + j) == w).otherwise(False))
    equal = F.transform(equal, lambda x: F.coalesce(x, F.lit(False)).cast("int"))
    judged = pairs.select("row", "doc_id", "key", "shift", "low", "at", "size", "needed", equal.alias("equal"))
    begins = F.sequence(F.lit(0), F.size("equal") - F.col("size"))
    sums = F.transform(begins, lambda k: F.aggregate(F.slice("equal", k + 1, F.col("size")), F.lit(0), lambda n, x: n + x))
    judged = judged.withColumn("sums", sums).where(F.array_max("sums") >= F.col("needed"))
    inside = F.filter(
        "at",
        lambda h: F.exists(
            F.transform("sums", lambda n, k: F.struct(n.alias("n"), (F.col("low") + k).alias("low"))),
            lambda w: (w.n >= F.col("needed")) & (w.low <= h.place) & (h.place + h.span <= w.low + F.col("size")),
        ),
    )
    judged = judged.select("row", "doc_id", "key", "shift", "size", F.array_max("sums").alias("matched"), inside.alias("at"))
    # segments of one placement put together again
    judged = judged.groupBy("row", "doc_id", "key", "shift").agg(
        F.max("matched").alias("matched"), F.max("size").alias("size"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hits")
    )
    each = judged.join(named.select("key", "item_id"), "key")
    return each.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("size").alias("compared"), F.sum("hits").cast("long").alias("hits")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap with a benchmark item; every row is judged by its own text."""
    name = "_row_key"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    keyed = docs.withColumn(name, F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    bad = overlaps(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(stored(bad, "contaminated"), name, "left_anti").select(*docs.columns)
