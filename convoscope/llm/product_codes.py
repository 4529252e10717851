"""Vector codes by product quantisation, entries found by Orchard's search.

Vectors are scaled to integers and cut into equal consecutive parts.  Each part
position has a codebook; it starts as that part of the vectors with the smallest
ids and is moved to the floored means of its parts in a fixed number of rounds.
A round is one pass over the rows: a task sends per part, entry and position one
sum, never a row, and the codebooks (entries x vector length numbers) travel
with the tasks.

The nearest entry is found by Orchard's search.  For every entry the others are
listed by their distance from it.  A search holds its best entry so far and
walks along that entry's list; an entry that is nearer becomes the best and its
list is walked instead; entries already compared are marked and not compared
again; the walk ends at the first listed entry farther from the best than twice
the best distance, for by the triangle inequality no entry beyond can be as
near.  All parts of a block of rows walk together, a step at a time, as array
operations.  Everything is integer arithmetic (squared distances, so the limit
is four times the best), in Python integers where 64 bits don't suffice.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do those whose length isn't a multiple of ``parts``
or differs from that of the smallest id; rows without id are coded and start no
entry while there are others; equal ids start entries in the order of their
vectors; repeated rows are coded each; fewer rows than ``entries`` give fewer
entries; no rows give no codebook and no codes.  A squared error beyond 64 bits raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoscope.llm.tables import stored

BLOCK_PARTS = 1 << 17  # parts of vectors that walk together
SUMS = "part int, entry int, place int, n long, total decimal(38,0)"
LABELS_BROADCAST = 100_000  # label sums below this number of rows are broadcast


def usable(vector: str, parts: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def _integers(rows: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(rows.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0.0) < 2.0**26:
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(scaled)  # Python integers: squares may pass 64 bits


def _squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


class Codebooks:
    """Entries per part position, with every entry's list of the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (parts, entries, positions)
        parts, count, _ = entries.shape
        gaps = _squared(entries[:, :, None, :] - entries[:, None, :, :])
        ranked = np.argsort(gaps, axis=2, kind="stable")
        own = np.arange(count)[None, :, None]
        # every entry but the list's own (which need not be first, if there are equal entries)
        self.near = ranked[ranked != own].reshape(parts, count, count - 1)
        self.gap = np.take_along_axis(gaps, self.near, axis=2)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """points (rows, parts, positions) -> (entry, squared distance), both (rows, parts)."""
        rows, parts, _ = points.shape
        step = max(1, BLOCK_PARTS // parts)
        found = [self._walk(points[a : a + step]) for a in range(0, rows, step)]
        if not found:
            return np.zeros((0, parts), np.int64), np.zeros((0, parts), np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, parts, width = block.shape
        points = block.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        count = self.entries.shape[1]
        best = np.zeros(len(points), np.int64)
        distance = _squared(points - self.entries[part, 0])
        marked = np.zeros((len(points), count), bool)
        marked[:, 0] = True
        step = np.zeros(len(points), np.int64)
        walking = np.arange(len(points) if count > 1 else 0)
        while len(walking):
            p, b, s = part[walking], best[walking], step[walking]
            on = (self.gap[p, b, s] <= 4 * distance[walking]).astype(bool)
            walking, p, b, s = walking[on], p[on], b[on], s[on]
            entry = self.near[p, b, s]
            step[walking] = s + 1
            new = ~marked[walking, entry]
            which, entry = walking[new], entry[new]
            marked[which, entry] = True
            d = _squared(points[which] - self.entries[part[which], entry])
            nearer = ((d < distance[which]) | ((d == distance[which]) & (entry < best[which]))).astype(bool)
            which = which[nearer]
            best[which], distance[which], step[which] = entry[nearer], d[nearer], 0
            walking = walking[step[walking] < count - 1]
        return best.reshape(rows, parts), distance.reshape(rows, parts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _vectors(batch: pa.RecordBatch, column: str, scale: int, parts: int) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // max(1, len(lists))
    return _integers(flat.reshape(len(lists), width), scale).reshape(len(lists), parts, width // parts)


def _sums(vectors: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    parts, count, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((parts, count), np.int64)
        total = np.zeros((parts, count, width), object)
        for batch in batches:
            points = _vectors(batch, "vector", scale, parts)
            entry, _ = books.nearest(points)
            which = (np.arange(parts)[None, :] * count + entry).ravel()
            held += np.bincount(which, minlength=parts * count).reshape(parts, count)
            sums = np.zeros((parts * count, width), points.dtype)
            np.add.at(sums, which, points.reshape(-1, width))
            total += sums.reshape(parts, count, width)
        part, entry, place = (x.ravel() for x in np.indices((parts, count, width)))
        some = held[part, entry] > 0
        part, entry, place = part[some], entry[some], place[some]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(place, pa.int32()),
                pa.array(held[part, entry], pa.int64()),
                pa.array([int(x) for x in total[part, entry, place]], pa.decimal128(38, 0)),
            ],
            names=["part", "entry", "place", "n", "total"],
        )

    sent = vectors.select("vector").mapInArrow(run, SUMS)
    return sent.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def _kept(rows: DataFrame, vector: str, width: int, parts: int) -> DataFrame:
    return rows.where(usable(vector, parts) & (F.size(vector) == width))


def train(rows: DataFrame, vector: str, row_id: str, scale: int, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks from all rows; None if no vector can be coded."""
    rows = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("vector"))
    first = rows.where(usable("vector", parts)).orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    kept = _kept(rows, "vector", len(first[0].vector), parts)
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    points = _integers(np.array([r.vector for r in start]), scale).reshape(len(start), parts, -1)
    books = Codebooks(points.transpose(1, 0, 2).copy())
    for _ in range(rounds):
        moved = books.entries.astype(object)
        for r in _sums(kept, books, scale).collect():  # one row per number of the codebooks
            moved[r.part, r.entry, r.place] = int(r.total) // r.n
        small = max(abs(x) for x in moved.ravel()) < 1 << 26
        books = Codebooks(moved.astype(np.int64) if small else moved)
    return books


def encode(rows: DataFrame, books: Codebooks | None, vector: str, row_id: str, label: str, scale: int) -> DataFrame:
    """(row_id, label, code, error, label_error): the entries of a row's parts as two hex digits each,
    its summed squared distances, and those of all rows of its label (rows without label together)."""
    rows = rows.select(F.col(row_id).alias(row_id), F.col(vector).alias("vector"), F.col(label).alias(label))
    id_type, label_type = rows.schema[row_id].dataType.simpleString(), rows.schema[label].dataType.simpleString()
    shape = f"`{row_id}` {id_type}, `{label}` {label_type}, code string, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], shape + ", label_error long")
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = books.nearest(_vectors(batch, "vector", scale, parts))
            code = [e.tobytes().hex() for e in entry.astype(np.uint8)]
            error = [sum(int(x) for x in d) for d in distance] if distance.dtype == object else distance.sum(axis=1)
            columns = [batch.column(row_id), batch.column(label), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[row_id, label, "code", "error"])

    codes = stored(_kept(rows, "vector", parts * width, parts).mapInArrow(run, shape), "codes")
    sums = stored(codes.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= LABELS_BROADCAST:
        sums = F.broadcast(sums)
    joined = codes.join(sums, F.col(label).eqNullSafe(F.col("__label")))
    return joined.select(row_id, label, "code", "error", "label_error")
