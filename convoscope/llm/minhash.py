"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates.

1. One pass over the texts hashes each document's distinct word shingles once,
   keeps the smallest hash per bin (one permutation), and fills empty bins by
   optimal densification: an empty bin copies the first non-empty bin of its own
   fixed random probe order.  Rows of bins hash to band keys.
2. Documents with the same shingle set collapse to their smallest id, so a
   group of copies enters the search once, however large.
3. Documents that share a band key are a bucket.  Candidates are stars: each
   member is paired with the bucket's centre, the member that collides most over
   all bands (an original collides with more of its edited copies than they do
   with each other).  Pairs per round are bounded by members, never squared.
4. Pairs are confirmed on full shingle sets by exact counts.
5. While a bucket still holds documents of different components, the next
   centre gets its star; these rounds go on while they find links.
6. The members of buckets that then still hold different components and untried
   centres are compared among each other without further rounds: every pair at the
   wanted similarity shares one of the rarest shingles of each (prefix filter), so
   only pairs of different components that do are confirmed.  Sizes and places in the
   order of rarity are part of the join key, so that what a whole family has in common
   brings no pairs.  No link is lost here.
7. Components come from the confirmed links.

The number of bands of 5 bins follows from the wanted similarity: a pair at it
shares no band with probability (1 - s**5)**bands, at most 1e-6 (24 bands at 0.85,
35 at 0.80).

Defined results: a null or blank text has no shingles, n_shingles 0, and is its
own component; a text shorter than the shingle is one shingle; a null doc_id
takes part in no link and is kept with a null component; rows that share a
doc_id are one document as far as links go; no rows give no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import tokens
from convoscope.llm.components import components
from convoscope.llm.tables import stored

SHINGLE = 5
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: A pair at the wanted similarity shares no band with this probability at most.
LOSS = 1e-6
#: Counters that the rarity of shingles is read from (their number doesn't decide what is found).
CELLS = 1 << 20
#: Ratio of neighbouring size classes (finer classes let fewer pairs meet, and cost more rows).
SIZE_STEP = 1.02
PIECE = 2 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and where each text's begin."""
    data = tokens.LOWER[data]
    starts, ends, begin = tokens.word_bounds(data, offsets)
    words = tokens.word_hashes(data, starts, ends)
    at, keys = tokens.window_hashes(words, begin, width)
    first = np.searchsorted(at, begin)
    n = np.diff(begin)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):  # the whole sequence is the only shingle
        whole = np.array(
            [tokens.window_hashes(words[begin[k] : begin[k + 1]], np.array([0, n[k]]), int(n[k]), salt=int(n[k]))[1][0] for k in short],
            np.uint64,
        )
        keys = np.insert(keys, first[short], whole)
        first = first + np.concatenate([[0], np.cumsum((n > 0) & (n < width))])
    keys = np.minimum(keys, EMPTY - np.uint64(1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        keys[a:b].sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    fresh[first[:-1][first[:-1] < len(keys)]] = True
    return keys[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def bands_for(percent: int) -> int:
    """The least number of bands that keeps to LOSS."""
    same = min(max(percent, 1), 100) / 100
    return 1 if same == 1 else math.ceil(math.log(LOSS) / math.log1p(-(same**ROWS)))


def _probe(attempt: int, bins: np.ndarray, width: int) -> np.ndarray:
    """The bin that each empty bin looks at in its ``attempt``-th try."""
    return (tokens.mix(bins.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt), 7) % np.uint64(width)).astype(np.int64)


def signatures(keys: np.ndarray, begin: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per text (all EMPTY for a text without shingles)."""
    n = len(begin) - 1
    out = np.full(n * bins, EMPTY, np.uint64)
    text = np.repeat(np.arange(n), np.diff(begin))
    cell = text * bins + ((keys >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]  # hashes ascend within a text, so a cell's first is its least
    out[cell[lead]] = keys[lead]
    out = out.reshape(n, bins)
    filled = out != EMPTY
    row, col = np.nonzero(~filled & (np.diff(begin) > 0)[:, None])
    attempt = 0
    while len(row):
        look = _probe(attempt, col, bins)
        found = filled[row, look]
        out[row[found], col[found]] = out[row[found], look[found]]
        row, col = row[~found], col[~found]
        attempt += 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    n, bands = len(signature), signature.shape[1] // ROWS
    rows = signature.reshape(n, bands, ROWS)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(ROWS):
        key = tokens.mix(key ^ rows[:, :, k], k)
    return key.view(np.int64)


def _by_piece(batch: pa.RecordBatch):
    data, offsets = tokens.flat(batch.column("text"))
    for a, b in tokens.pieces(offsets, PIECE):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def sketches(docs: DataFrame, width: int, count: int = BANDS) -> DataFrame:
    """doc_id, n (set size), fp1 and fp2 (128-bit fingerprint of the set), bands."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, data, offsets in _by_piece(batch):
                keys, begin = shingles(data, offsets, width)
                n = np.diff(begin)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(keys, s), dtype=np.uint64)]) for s in (11, 12)]
                fp = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
                bands = band_keys(signatures(keys, begin, count * ROWS)).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(fp[0]),
                        pa.array(fp[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, count), pa.int32()), pa.array(bands)),
                    ],
                    ["doc_id", "n", "fp1", "fp2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingle_set (its hashes, ascending as unsigned numbers)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b, data, offsets in _by_piece(batch):
                keys, begin = shingles(data, offsets, width)
                held = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), held], ["doc_id", "shingle_set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle_set array<long>")


def judged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(centre, node) -> centre, node, same: whether 100 * intersection >= percent * union."""
    of = lambda c, held: sets.select(F.col("doc_id").alias(c), F.col("shingle_set").alias(held)).hint("merge")
    both = pairs.join(of("node", "a"), "node").join(of("centre", "b"), "centre")
    near = f"100 * least(size(a), size(b)) >= {percent}L * greatest(size(a), size(b))"
    same = f"(100L + {percent}) * size(array_intersect(a, b)) >= {percent}L * (size(a) + size(b))"
    return both.select("centre", "node", F.expr(f"CASE WHEN {near} THEN {same} ELSE false END").alias("same"))


def rarest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """nodes(node, component) -> node, component, n, place, shingle: the first shingles of each set in
    one order of all shingles, rare ones first.  Of two sets at ``percent`` or more the first shingle
    in common is among them on both sides, whatever the order; a good one makes few sets share one.
    None where there are no nodes."""
    spark = nodes.sparkSession
    named = sets.select(F.col("doc_id").alias("node"), "shingle_set").hint("merge")
    held = stored(nodes.join(named, "node"), "unsettled")
    if held.isEmpty():
        return None

    def cells(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in found:
            keys = batch.column("shingle_set").flatten().to_numpy().view(np.uint64)
            np.add.at(n, (keys % np.uint64(CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["cell", "n"])

    counted = held.select("shingle_set").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    often = np.zeros(CELLS, np.int64)
    for batch in counted.toArrow().to_batches():  # CELLS rows at most
        often[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in found:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                held = part.column("shingle_set")
                n = pc.list_value_length(held).to_numpy().astype(np.int64)
                first = []
                for keys in np.split(held.flatten().to_numpy().view(np.uint64), np.cumsum(n)[:-1]):
                    # a partner has at least this many of the shingles, so one of the others' number and one is shared
                    least = -(-percent * len(keys) // 100)
                    first.append(keys[np.lexsort((keys, often[(keys % np.uint64(CELLS)).astype(np.int64)]))][: len(keys) - least + 1])
                size = np.array([len(f) for f in first])
                row = np.repeat(np.arange(len(first)), size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(row)),
                        part.column("component").take(pa.array(row)),
                        pa.array(n[row], pa.int64()),
                        pa.array(place, pa.int64()),
                        pa.array(np.concatenate(first).view(np.int64)),
                    ],
                    ["node", "component", "n", "place", "shingle"],
                )

    return held.mapInArrow(run, "node long, component long, n long, place long, shingle long")


def across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """nodes(node, component) -> centre, node: all pairs of different components that can reach ``percent``;
    None where there are no nodes.

    A set's shingle at some place of the order leaves ``n - place`` shingles, which bounds the size of a
    partner whose first shingle in common it can be.  So a row meets only rows of the size classes that its
    place still allows: the shingles that a whole family has come last in the order, where a set allows
    hardly any partner, and rows of equal size don't meet there at all."""
    first = rarest(nodes, sets, percent)
    if first is None:
        return None
    first = stored(first, "rarest")
    mixed = first.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    first = first.join(mixed.select("shingle"), "shingle")
    size_class = lambda n: f"CAST(floor(ln({n}) / ln({SIZE_STEP})) AS INT)"
    low = f"(n * {percent} + 99) div 100"
    high = f"least((n - place) * (100 + {percent}) div {percent} - n, n * 100 div {percent})"
    first = first.withColumn("low", F.expr(low)).withColumn("high", F.expr(high)).where("high >= low")
    rows = first.select("*", F.expr(size_class("n")).alias("own"), F.expr(f"explode(sequence({size_class('low')}, {size_class('high')}))").alias("other"))
    rows = rows.select("shingle", F.least("own", "other").alias("lower"), F.greatest("own", "other").alias("upper"), "own", "component", "node", "n", "place")
    key = ["shingle", "lower", "upper"]
    ends = rows.groupBy(*key).agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min("own").alias("from"), F.max("own").alias("to")
    )
    ends = ends.where("least < most AND from = lower AND to = upper").select(*key)
    rows = stored(rows.join(ends, key), "sized")
    # a large component's own members never meet: components are paired first
    owners = lambda x, at: rows.where(f"own = {at}").select(*key, F.col("component").alias(f"component_{x}")).distinct()
    met = owners("a", "lower").join(owners("b", "upper"), key)
    met = met.where("component_a < component_b OR (component_a > component_b AND lower < upper)")
    of = lambda x, at: rows.where(f"own = {at}").select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("component", "node", "n", "place")))
    pairs = met.join(of("a", "lower"), [*key, "component_a"]).join(of("b", "upper"), [*key, "component_b"])
    # at the first shingle in common, what is left of either set must do for the shingles wanted in common
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    rest = f"(100 + {percent}) * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    pairs = pairs.where(f"{fits} AND {rest}")
    return pairs.select(F.least("node_a", "node_b").alias("centre"), F.greatest("node_a", "node_b").alias("node")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(sketches(docs, width, bands_for(percent)), "sketches")
    classes = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n")
    # equal sets have equal bands
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    rows = classes.select(F.col("rep").alias("node"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(rows.join(shared, "key").distinct(), "members")  # rows that repeat under one id count once
    # both grow with the corpus, so they are merged, never broadcast
    nodes = members.select(F.col("node").alias("doc_id")).distinct().hint("merge")
    sets = full_sets(docs.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), width)
    sets = stored(sets, "sets")

    # the order in which a bucket's members become centres: most collisions, then smallest id
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    rank = F.struct("degree", (-F.col("node")).alias("low")).alias("rank")
    ranked = members.join(degree, "node").select("key", "node", rank, F.col("node").alias("component"))
    own = F.struct("rank", "component")
    buckets = stored(ranked.join(ranked.groupBy("key").agg(F.max(own).alias("centre")), "key"), "buckets")

    links = labels = tested = None
    while True:
        # only pairs that would join two components, and were not judged before
        pairs = buckets.where("rank < centre.rank AND component <> centre.component")
        pairs = pairs.select((-F.col("centre.rank.low")).alias("centre"), "node").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["centre", "node"], "left_anti")
        pairs = stored(judged(pairs, sets, percent), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = pairs.where("same")
        fruitless = new.isEmpty()
        if not fruitless:
            links = new if links is None else links.unionByName(new)
            labels = components(links, "centre", "node")
            buckets = buckets.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = buckets.groupBy("key").agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.when(F.expr("rank < centre.rank"), own)).alias("next")
        )
        mixed = mixed.where("least < most AND next IS NOT NULL").select("key", "next")
        # buckets with one component, and those without centres left, are done
        buckets = buckets.join(mixed, "key").select("key", "node", "rank", "component", F.col("next").alias("centre"))
        if fruitless:
            break
        buckets = stored(buckets, "buckets")
        if buckets.isEmpty():
            break
    # every bucket with centres left is settled at once, however many rounds its members would take
    pairs = across(buckets.select("node", "component").distinct(), sets, percent)
    if pairs is not None:
        before = tested.select(F.least("centre", "node").alias("centre"), F.greatest("centre", "node").alias("node"))
        pairs = pairs.join(before, ["centre", "node"], "left_anti")
        new = stored(judged(pairs, sets, percent), "pairs").where("same")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links, "centre", "node")
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("long"))
    found = classes.select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n", "fp1", "fp2").join(found, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of near-duplicates, the one with the
    smallest id; all columns stay.  Rows without id, and rows whose id has other texts too, go by
    id and text, after all others; texts without words are linked with nothing and stay."""
    names = [c.lower() for c in docs.columns]
    name, many = (next(n for n in (f"{base}{'_' * k}" for k in range(len(names) + 1)) if n not in names) for base in ("_row_key", "_many"))
    wordless = ~F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    held = docs.where(~wordless)
    ids = held.where("doc_id IS NOT NULL").select(F.col("doc_id"), F.xxhash64("text").alias("h"))
    several = ids.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    several = stored(several.select(F.col("doc_id").alias(many)), "repeated-ids")
    keyed = held.join(several.hint("merge"), held["doc_id"] == several[many], "left") if not several.isEmpty() else held.withColumn(many, F.lit(None))
    by_text = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    key = F.when(F.col("doc_id").isNull() | F.col(many).isNotNull(), by_text).otherwise(F.col("doc_id").cast("long"))
    keyed = keyed.select(*docs.columns, key.alias(name))
    judged = near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text"), percent, width)
    kept = judged.where("kept").select(F.col("doc_id").alias(name)).distinct()
    kept = stored(kept, "kept").hint("merge")  # grows with the corpus: never broadcast
    row = F.struct(*docs.columns)
    one = keyed.join(kept, name, "left_semi").groupBy(name).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return one.unionByName(docs.where(wordless))
