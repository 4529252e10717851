"""Removal of word windows that repeat anywhere: Rabin-Karp hashes of every window, counted.

Every window of ``width`` consecutive words of one text gets a rolling hash.
Spark counts equal hashes over the whole corpus (``batches``); a window counted
twice or more, in the same text or another, is repeated, and the words that
repeated windows cover merge into maximal intervals.  Windows are judged on the
input, so every copy goes, not all but one.

Hash width: buckets take a bounded number of hashes whatever the corpus size,
so a window meets at most ``BUCKET_HASHES`` others times 2**-64 chances of a
false match (about 2e-14), at any scale.

Defined results: a null or empty text, or one shorter than ``width`` words, has
no window and nothing removed; a null doc_id is kept as null; rows that repeat
are separate texts, so their windows repeat; no rows give no rows; only
``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import batches, tokens

SCHEMA = "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, kept binary"
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
PIECE = 2 << 20


def _windows(table: pa.Table, width: int):
    """Of a batch: begin of each text's words, first word and hash of each window."""
    data, offsets = tokens.flat(table["text"])
    hashes, counts = [], []
    for a, b in tokens.pieces(offsets, PIECE):
        part = data[offsets[a] : offsets[b]]
        starts, ends, begin = tokens.word_bounds(part, offsets[a : b + 1] - offsets[a])
        hashes.append(tokens.word_hashes(part, starts, ends))
        counts.append(np.diff(begin))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    at, keys = tokens.window_hashes(words, begin, width)
    return begin, at, keys


def remove_repeated_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, spans (maximal removed word intervals, end
    exclusive), kept (the remaining words joined by one space)."""
    if width < 1:
        raise ValueError("width must be at least 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = batches.text_bytes(docs)
    # a word and its blank take two bytes at least, 4 to 7 in prose; this only sizes the buckets
    buckets = max(1, size // (6 * batches.BUCKET_HASHES))
    dealt = batches.text_batches(docs, size)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, _, keys = _windows(batches.in_order(table), width)
        unique, count = np.unique(keys, return_counts=True)
        return batches.requests(key[0].as_py(), unique, count > 1, buckets)

    def finish(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        table = batches.in_order(table)
        begin, at, keys = _windows(table, width)
        unique, which = np.unique(keys, return_inverse=True)
        repeated = batches.repeated_hashes(unique, answer, buckets)
        gone = tokens.covered(at[repeated[which]], width, int(begin[-1]))
        first, end = tokens.runs(gone, begin)
        text_of = np.searchsorted(begin, first, side="right") - 1
        spans: list[list] = [[] for _ in range(len(table))]
        for k, a, b in zip(text_of.tolist(), (first - begin[text_of]).tolist(), (end - begin[text_of]).tolist(), strict=True):
            spans[k].append({"begin": a, "end": b})
        kept = []
        for k, text in enumerate(table["text"].cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            if spans[k]:
                words = compress(words, (~gone[begin[k] : begin[k + 1]]).tolist())
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(np.diff(begin), pa.int64()),
                "spans": pa.array(spans, SPANS),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    answered = batches.answers(dealt.groupBy("batch").applyInArrow(ask, batches.REQUEST))
    out = dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(finish, SCHEMA)
    return out.withColumn("kept", F.col("kept").cast("string"))
