"""Texts in batches of bounded size, and the question "which hashes do others have too?".

``text_batches`` deals rows by a hash of the whole row's id and text into
batches of a few MB, however skewed the ids, sources or copies are.
``repeated_elsewhere`` is a two-way exchange: each batch sends the distinct
64-bit hashes it holds, packed, to buckets of bounded size; each bucket answers
with one bit per hash.  A hash that millions of rows share is sent once per
batch, so no bucket grows with a hot hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BUCKET_HASHES = 400_000

REQUEST = "bucket long, batch long, hashes binary, twice binary"
ANSWER = "batch long, bucket long, repeated binary, hot binary"


def batch_of(count: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, count))).cast("long")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one aggregate, one number to the driver."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def text_batches(docs: DataFrame, size: int) -> DataFrame:
    """(batch, doc_id, text) from docs(doc_id, text); ``size``: bytes of all texts."""
    count = -(-max(1, size) // BATCH_BYTES)
    return docs.select(batch_of(count, F.col("doc_id"), F.col("text")).alias("batch"), "doc_id", "text")


def in_order(table: pa.Table) -> pa.Table:
    """A batch's rows in an order that doesn't depend on how Spark delivered them."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def requests(batch: int, hashes: np.ndarray, twice: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket with this batch's distinct hashes (ascending) and a flag
    for those that the batch itself already has twice."""
    bucket = bucket_of(hashes, buckets)
    order = np.lexsort((hashes, bucket))
    bucket, hashes, twice = bucket[order], hashes[order], twice[order]
    used, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))[: len(first)]
    return pa.table(
        {
            "bucket": pa.array(used, pa.int64()),
            "batch": pa.array(np.full(len(used), batch), pa.int64()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
            "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
        }
    )


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def _answer(table: pa.Table, hot_from: int) -> pa.Table:
    raw = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    flags = [
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool)
        for x, h in zip(table["twice"].to_pylist(), raw, strict=True)
    ]
    _, which, holders = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
    own = np.zeros(len(holders), bool)
    own[which[np.concatenate(flags)]] = True
    ends = np.cumsum([len(x) for x in raw])
    bits = lambda marks: pa.array([np.packbits(marks[which[b - len(x) : b]]).tobytes() for x, b in zip(raw, ends, strict=True)], pa.binary())
    return pa.table(
        {"batch": table["batch"], "bucket": table["bucket"], "repeated": bits(own | (holders > 1)), "hot": bits(holders >= hot_from)}
    )


def answers(asked: DataFrame, hot_from: int = 1 << 62) -> DataFrame:
    """For every request row, one bit per hash: is it in another batch, or twice in some batch?
    And one more: do at least ``hot_from`` batches have it?"""

    def run(table: pa.Table) -> pa.Table:
        return _answer(table, hot_from)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def repeated_hashes(hashes: np.ndarray, answer: pa.Table, buckets: int, which: str = "repeated") -> np.ndarray:
    """Flags (repeated or hot) for a batch's distinct hashes from the rows that came back for it."""
    bucket = bucket_of(hashes, buckets)
    order = np.lexsort((hashes, bucket))
    ordered = bucket[order]
    flags = np.zeros(len(hashes), bool)
    for k, bits in zip(answer["bucket"].to_pylist(), answer[which].to_pylist(), strict=True):
        a, b = np.searchsorted(ordered, [k, k + 1])
        flags[order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return flags
