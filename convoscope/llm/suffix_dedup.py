"""Removal of long byte strings that an earlier document has, by suffix arrays.

A string of ``width`` bytes goes from a document if it also starts in a document
with a smaller id; what remains is the rest of the bytes.

1. Candidates.  Every window of ``width`` bytes has a key, the least hash of the
   ``GRAM``-byte strings in it, so equal windows have equal keys.  Neighbouring
   windows mostly share theirs: a document sends one key per stretch of windows.
   Keys that only one document has are dropped (``batches``).
2. Contexts.  A stretch whose key others have too sends its bytes, once per
   batch however many copies the batch holds, to the bucket of its key.  A key
   that more than ``HOT`` batches have sends single windows, dealt by their own
   hash, so that a phrase which everybody uses doesn't fill one bucket.
3. Suffix arrays.  A bucket collapses equal contexts under their smallest id and
   lays the different contexts of each key side by side in a short text, whose
   suffixes are sorted by linear grouping construction (``lyndon``).  Equal
   windows are then neighbours; each gets the smallest id that has it.  A key
   with one context has nothing to sort; one with over ``CROWD`` different
   contexts has its windows collapsed instead of its contexts, as texts that long
   would take as many steps.
4. Each document removes the bytes of its windows that a smaller id has.

Defined results: a null or empty text, or one shorter than ``width``, loses
nothing; a null doc_id comes after all others; rows that repeat an id are the
same document and don't take from each other; no rows give no rows; only
doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import batches, lyndon, tokens

GRAM = 24
#: Batches that share a key before its windows travel singly.
HOT = 1_000
#: Different contexts of a key whose suffixes are sorted together, at most.
CROWD = 32
#: Bytes of a text whose suffixes are sorted, about, and of all texts sorted together.
LANE, TOGETHER = 200, 1_000_000
BUCKET_BYTES = 8 << 20
PIECE = 1 << 20
LAST = np.int64(0x7FFFFFFFFFFFFFFF)  # stands for a null id

SEND = "bucket long, batch long, contexts binary"
JUDGED = "batch long, bucket long, smallest binary"
SCHEMA = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def gram_keys(data: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` bytes, the least hash of the GRAM-byte strings in it."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded.data, 0, (1,))
    m = n - GRAM + 1
    least = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    for at, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        least ^= least >> np.uint64(29)
        least += eight[at : at + m] * np.uint64(c)
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    least ^= least >> np.uint64(29)
    span, reach = width - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(least) - (span - reach)], least[span - reach :]) if span > reach else least


def string_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + size], from prefix sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tokens.powers(tokens.WORD_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    inverse = tokens.powers(pow(tokens.WORD_BASE, -1, 1 << 64), len(data) + 1)
    return tokens.mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


class Batch:
    """One batch of documents and the stretches of windows in it (``start``: byte of the
    first window, ``count``: windows, ``key``, ``doc``: row)."""

    def __init__(self, table: pa.Table, width: int):
        self.table, self.width = batches.in_order(table), width
        self.ids = self.table["doc_id"].fill_null(LAST).to_numpy()
        self.data, self.offsets = tokens.flat(self.table["text"])
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in tokens.pieces(self.offsets, PIECE):
            base = self.offsets[a]
            offsets = self.offsets[a : b + 1] - base
            keys = gram_keys(self.data[base : base + offsets[-1]], width)
            inside = np.zeros(len(keys) + 1, np.int64)
            valid = np.maximum(np.diff(offsets) - width + 1, 0)
            some = valid > 0
            np.add.at(inside, offsets[:-1][some], 1)
            np.add.at(inside, (offsets[:-1] + valid)[some], -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            if not len(at):
                continue
            lead = np.ones(len(at), bool)
            lead[1:] = (keys[at[1:]] != keys[at[:-1]]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(lead)
            count = np.diff(np.append(first, len(at)))
            start = at[first]
            parts = -(-count // (width - GRAM + 1))  # equal grams in a row give long stretches: cut them
            within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(start, parts) + within * (width - GRAM + 1)
            size = np.minimum(np.repeat(start + count, parts) - begin, width - GRAM + 1)
            found.append((begin + base, size, keys[begin], np.searchsorted(offsets, begin, side="right") - 1 + a))
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else none
        self.start, self.count, self.key, self.doc = cols
        #: distinct keys, and which of them each stretch has
        self.keys, self.which = np.unique(self.key, return_inverse=True)

    def twice(self) -> np.ndarray:
        """For every distinct key, whether two documents of this batch have it."""
        ids = self.ids[self.doc]
        least, most = np.full(len(self.keys), LAST), np.full(len(self.keys), -LAST)
        np.minimum.at(least, self.which, ids)
        np.maximum.at(most, self.which, ids)
        return least < most

    def contexts(self, shared: np.ndarray, hot: np.ndarray, buckets: int):
        """The stretches with a shared key, those of hot keys as single windows; returns start,
        count and doc of each, the distinct context it is an instance of, and of the distinct
        contexts in the order they are sent: bucket, an instance, single or not, least id."""
        keep = np.flatnonzero(shared[self.which])
        single = hot[self.which[keep]]
        times = np.where(single, self.count[keep], 1)
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        start = np.repeat(self.start[keep], times) + within
        count = np.repeat(np.where(single, 1, self.count[keep]), times)
        doc, single, key = np.repeat(self.doc[keep], times), np.repeat(single, times), np.repeat(self.key[keep], times)
        name = np.zeros(len(start), np.uint64)
        for a, b in tokens.pieces(self.offsets, PIECE):
            x, y = np.searchsorted(start, [self.offsets[a], self.offsets[b]])
            base = self.offsets[a]
            name[x:y] = string_hashes(self.data[base : self.offsets[b]], start[x:y] - base, count[x:y] + self.width - 1)
        _, instance, of = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(instance), LAST)
        np.minimum.at(least, of, self.ids[doc])
        group = np.where(single, name, key)[instance]
        bucket = batches.bucket_of(group, buckets)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return start, count, doc, back[of], bucket[order], instance[order], single[instance[order]], least[order]


def _pack(*parts: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.int64(len(p)).tobytes() + p.tobytes() for p in parts), 1)


def _unpack(raw: bytes, *types: type) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(raw), 0, []
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def smallest_ids(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """For every window of the contexts data[start : start+size], in their order, the
    smallest id of a context of the same group with an equal window."""
    windows = size - width + 1
    out = np.repeat(ids, windows)
    first = np.cumsum(windows) - windows
    order = np.argsort(group, kind="stable")
    # lanes: whole groups up to LANE bytes; chunks: whole lanes up to TOGETHER bytes
    length = size[order] + 1
    lead = np.ones(len(order), bool)
    lead[1:] = group[order][1:] != group[order][:-1]
    edges = np.append(np.flatnonzero(lead), len(order))
    ends = np.append(0, np.cumsum(length))[edges]
    lanes, a = [0], 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + LANE, side="right")) - 1)
        lanes.append(int(edges[b]))
        a = b
    # lanes of about the same length go together, as a chunk takes as many steps as its longest
    lane_at, held = np.array(lanes[:-1], np.int64), np.diff(lanes)
    long = np.diff(np.append(0, np.cumsum(length))[lanes])
    by = np.argsort(long, kind="stable")
    total = np.append(0, np.cumsum(long[by]))
    a = 0
    while a < len(by):
        b = max(a + 1, int(np.searchsorted(total, total[a] + TOGETHER, side="right")) - 1)
        pick = by[a:b]
        mine = order[lyndon._ranges(lane_at[pick], held[pick])]
        lane_of = np.repeat(np.arange(b - a), held[pick])
        _judge(data, start[mine], size[mine], lane_of, ids[mine], first[mine], width, out)
        a = b
    return out


def _judge(data, start, size, lane, ids, first, width, out) -> None:
    """Sort the suffixes of these lanes and lower ``out`` at first[k] ... for equal windows."""
    # a lane: something lower, then its contexts, each closed by 1 (bytes are 2 and up), then 0
    head = np.ones(len(lane), bool)
    head[1:] = lane[1:] != lane[:-1]
    at = np.cumsum(size + 1) - (size + 1) + 2 * np.cumsum(head) - 1
    n = int(at[-1] + size[-1] + 2)
    codes = np.zeros(n, np.int16)
    inner = lyndon._ranges(at, size)
    codes[inner] = data[lyndon._ranges(start, size)].astype(np.int16) + 2
    codes[at + size] = 1
    low = at[head] - 1
    lane_size = np.append(low[1:], n) - low - 1
    order = lyndon.suffix_order(codes, low, lane_size)
    context = np.full(n, -1, np.int32)
    windows = size - width + 1
    context[lyndon._ranges(at, windows)] = np.repeat(np.arange(len(at)), windows)
    order = order[context[order] >= 0]  # suffixes that begin a whole window, ascending in each lane
    flat = np.concatenate([codes.astype(np.uint8), np.zeros(8, np.uint8)])
    flat[inner] = data[lyndon._ranges(start, size)]
    eight = np.ndarray((n,), "<u8", flat.data, 0, (1,))
    same = np.ones(len(order) - 1, bool)
    lane_of = lane[context[order]]
    same &= lane_of[1:] == lane_of[:-1]
    for k in [*range(0, width - 8, 8), width - 8]:
        word = eight[order + k]
        same &= word[1:] == word[:-1]
    lead = np.flatnonzero(np.concatenate([[True], ~same]))
    c = context[order]
    least = np.minimum.reduceat(ids[c], lead)
    where = first[c] + (order - at[c])
    out[where] = np.repeat(least, np.diff(np.append(lead, len(order))))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, spans (maximal removed byte intervals, end
    exclusive), kept (the remaining bytes)."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = batches.text_bytes(docs)
    # about one stretch in fourteen bytes
    key_buckets = max(1, size // (14 * batches.BUCKET_HASHES))
    buckets = max(1, size // BUCKET_BYTES)
    dealt = batches.text_batches(docs, size)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        batch = Batch(table, width)
        return batches.requests(key[0].as_py(), batch.keys, batch.twice(), key_buckets)

    def known(table: pa.Table, answer: pa.Table):
        batch = Batch(table, width)
        shared = batches.repeated_hashes(batch.keys, answer, key_buckets)
        hot = batches.repeated_hashes(batch.keys, answer, key_buckets, "hot")
        return batch, batch.contexts(shared, hot, buckets)

    def send(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        batch, (start, count, _, _, bucket, instance, single, least) = known(table, answer)
        rows: dict[str, list] = {"bucket": [], "batch": [], "contexts": []}
        used, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(bucket))[: len(first)]
        for k, a, b in zip(used.tolist(), first.tolist(), ends.tolist(), strict=True):
            begin, size = start[instance[a:b]], count[instance[a:b]] + width - 1
            raw = batch.data[lyndon._ranges(begin, size)]
            rows["bucket"].append(k)
            rows["batch"].append(key[0].as_py())
            rows["contexts"].append(_pack(size.astype(np.int32), least[a:b], single[a:b].astype(np.uint8), raw))
        types = {"bucket": pa.int64(), "batch": pa.int64(), "contexts": pa.binary()}
        return pa.table({c: pa.array(rows[c], t) for c, t in types.items()})

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        got = [_unpack(x, np.int32, np.int64, np.uint8, np.uint8) for x in table["contexts"].to_pylist()]
        size = np.concatenate([g[0] for g in got]).astype(np.int64)
        ids = np.concatenate([g[1] for g in got])
        single = np.concatenate([g[2] for g in got]).astype(bool)
        data = np.concatenate([g[3] for g in got])
        start = np.cumsum(size) - size
        # the same context from several batches is laid out once, under its smallest id
        name = string_hashes_in_parts(data, start, size)
        _, instance, of = np.unique(name, return_index=True, return_inverse=True)
        order = np.argsort(instance)  # in the order of the bytes
        instance, of = instance[order], np.argsort(order)[of]
        least = np.full(len(instance), LAST)
        np.minimum.at(least, of, ids)
        begin, length = start[instance], size[instance]
        group = np.where(single, name, first_keys(data, start, width))[instance]
        _, at, crowd = np.unique(group, return_inverse=True, return_counts=True)
        windows = length - width + 1
        first = np.cumsum(windows) - windows
        answer = np.repeat(least, windows)
        few = np.flatnonzero((crowd[at] > 1) & (crowd[at] <= CROWD))
        if len(few):
            answer[lyndon._ranges(first[few], windows[few])] = smallest_ids(data, begin[few], length[few], group[few], least[few], width)
        many = np.flatnonzero(crowd[at] > CROWD)
        if len(many):
            one = lyndon._ranges(begin[many], windows[many])
            _, same = np.unique(string_hashes_in_parts(data, one, np.full(len(one), width)), return_inverse=True)
            smallest = np.full(len(one), LAST)
            np.minimum.at(smallest, same, np.repeat(least[many], windows[many]))
            answer[lyndon._ranges(first[many], windows[many])] = smallest[same]
        # back to each batch: runs of windows with the same smallest id
        lead = np.ones(len(answer), bool)
        lead[1:] = answer[1:] != answer[:-1]
        lead[first] = True
        run = np.flatnonzero(lead)
        run_id, run_size = answer[run], np.diff(np.append(run, len(answer)))
        run_of = np.searchsorted(run, first)
        runs = np.diff(np.append(run_of, len(run)))
        out, a = [], 0
        for g in got:
            mine = of[a : a + len(g[0])]
            pick = lyndon._ranges(run_of[mine], runs[mine])
            out.append(_pack(runs[mine].astype(np.uint16), run_size[pick].astype(np.uint16), run_id[pick]))
            a += len(g[0])
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "smallest": pa.array(out, pa.binary())})

    def finish(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        shape = answer.filter(pc.equal(answer["kind"], "keys"))
        batch, (start, _, doc, of, bucket, _, _, _) = known(table, shape)
        back = answer.filter(pc.equal(answer["kind"], "smallest"))
        back = back.sort_by("bucket")
        got = [_unpack(x, np.uint16, np.uint16, np.int64) for x in back["smallest"].to_pylist()]
        n = len(batch.data)
        change = np.zeros(n + 1, np.int64)
        if got:
            runs, run_size, run_id = (np.concatenate([g[k] for g in got]) for k in range(3))
            runs, run_size = runs.astype(np.int64), run_size.astype(np.int64)
            first = np.cumsum(runs) - runs
            total = np.cumsum(run_size)
            context_first = np.append(0, total)[first]  # windows before each context
            pick = lyndon._ranges(first[of], runs[of])
            each = np.repeat(np.arange(len(of)), runs[of])
            begin = start[each] + (total[pick] - run_size[pick]) - context_first[of[each]]
            gone = run_id[pick] < batch.ids[doc[each]]
            np.add.at(change, begin[gone], 1)
            np.add.at(change, (begin + run_size[pick] + width - 1)[gone], -1)
        removed = np.cumsum(change[:-1]) > 0
        first, end = tokens.runs(removed, batch.offsets)
        row = np.searchsorted(batch.offsets, first, side="right") - 1
        spans: list[list] = [[] for _ in range(len(batch.table))]
        for k, a, b in zip(row.tolist(), (first - batch.offsets[row]).tolist(), (end - batch.offsets[row]).tolist(), strict=True):
            spans[k].append({"begin": a, "end": b})
        kept = []
        for k, (a, b) in enumerate(zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist(), strict=True)):
            raw = batch.data[a:b]
            kept.append((raw[~removed[a:b]] if spans[k] else raw).tobytes())
        return pa.table(
            {
                "doc_id": batch.table["doc_id"],
                "n_bytes": pa.array(np.diff(batch.offsets), pa.int64()),
                "spans": pa.array(spans, SPANS),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    answered = batches.answers(dealt.groupBy("batch").applyInArrow(ask, batches.REQUEST), hot_from=HOT)
    sent = dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(send, SEND)
    judged = sent.groupBy("bucket").applyInArrow(judge, JUDGED)
    nothing = F.lit(None).cast("binary")
    both = answered.select("batch", "bucket", F.lit("keys").alias("kind"), "repeated", "hot", nothing.alias("smallest")).unionByName(
        judged.select("batch", "bucket", F.lit("smallest").alias("kind"), nothing.alias("repeated"), nothing.alias("hot"), "smallest")
    )
    return dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(finish, SCHEMA)


def first_keys(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The key of each context's first window (all its windows have the same)."""
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), PIECE):
        x, y = np.searchsorted(start, [a, a + PIECE])
        if x < y:
            out[x:y] = gram_keys(data[a : int(start[y - 1]) + width], width)[start[x:y] - a]
    return out


def string_hashes_in_parts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """string_hashes for ascending starts, a part of the data at a time."""
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), PIECE):
        x, y = np.searchsorted(start, [a, a + PIECE])
        if x < y:
            end = int((start[x:y] + size[x:y]).max())
            out[x:y] = string_hashes(data[a:end], start[x:y] - a, size[x:y])
    return out
