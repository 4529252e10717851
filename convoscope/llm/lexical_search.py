"""Ranked lexical search: the best position algorithm on impact lists of document blocks.

A document's score for an item is the sum of its impacts over the item's terms;
an impact is a term's weight times its saturated, length-normalised frequency, a
64-bit integer.  Two passes over the texts: the first counts documents, terms and
the document frequencies of the items' terms (a task sends one row per term), the
second searches.

A task of the second pass cuts its documents into blocks of a bounded number of
postings.  In a block every term has a list of its documents by descending impact,
and the same postings by document for direct access.  A search reads the item's
lists in parallel; each document met for the first time is looked up in all of
them, which marks its positions there as seen.  A list's best position is the end
of its run of seen positions from the top: lookups often carry it beyond the last
position read.  No unseen document can score more than the sum of the impacts at
the first unseen positions; the search stops once that sum is strictly below the
k-th score, so that equal scores are always found and ranked by id.  A task keeps
its k best per item from block to block, and a last step takes the k best of all
tasks.  Postings never leave their task, so a word that every document holds makes
no hot key.

Items are the queries.  They are taken in blocks of a bounded number of bytes, which
travel with the tasks; every block is searched against all documents.

Defined results: terms are runs of ASCII letters and digits and of characters beyond
ASCII, with A-Z lowered; a null or termless text matches nothing and isn't counted;
rows without doc_id take part and come last among equal scores; repeated documents
are ranked each; every row of the items is its own query, also with a null or
repeated item_id; no documents or items give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM_BYTES = 4 << 20
BLOCK_POSTINGS = 2_000_000
BLOCK_DOCS = 1 << 16
FIRST_DEPTH = 32
TOTALS = "term long, n long"
FOUND = "query long, item_id long, doc_id long, score long"
NO_ID = np.iinfo(np.int64).max

#: Every byte that is no part of a term becomes a blank; A-Z are lowered.
LETTERS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """(query number, item_id, its terms) in blocks; the driver holds one block at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for query, row in enumerate(rows.toLocalIterator()):
        terms = Counter(terms_of(bytes(row.text) if row.text is not None else None))
        if not terms:
            continue
        block.append((query, row.item_id, terms))
        size += len(row.text)
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, documents, length = set(vocabulary), Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                terms = terms_of(text.as_py())
                documents += bool(terms)
                length += len(terms)
                held.update(known.intersection(terms))
        term = [-2, -1, *(vocabulary[t] for t in held)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(term, pa.int64()), pa.array([documents, length, *held.values()], pa.int64())], names=["term", "n"]
        )

    sent = _texts(docs).select("text").mapInArrow(run, TOTALS)
    total = {r.term: r.n for r in sent.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the block
    held = np.array([total.get(t, 0) for t in range(len(vocabulary))], np.int64)
    return total.get(-2, 0), total.get(-1, 0), held


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(h) + 1))) for h in held], np.int64)


class ImpactLists:
    """A block's postings: by (term, impact descending, document) and by (term, document)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, ids: np.ndarray, vocabulary: int):
        self.ids = ids
        by_doc = np.lexsort((doc, term))
        term, self.doc, impact = term[by_doc], doc[by_doc], impact[by_doc]
        self.start = np.searchsorted(term, np.arange(vocabulary + 1))
        by_impact = np.lexsort((self.doc, -impact, term))
        self.listed, self.falling = self.doc[by_impact], impact[by_impact]
        self.impact = impact
        self.position = np.empty(len(term), np.int64)  # place in its list of the posting by document
        self.position[by_impact] = np.arange(len(term)) - self.start[term[by_impact]]

    def search(self, terms: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score): every document of the block that may be among the k best.

        terms: (term, times in the item).  floor: a score that k documents of other blocks reach."""
        lists = [(times, int(self.start[t]), int(self.start[t + 1])) for t, times in terms]
        lists = [x for x in lists if x[1] < x[2]]
        seen = [np.zeros(b - a, bool) for _, a, b in lists]
        best = [0] * len(lists)  # end of the run of seen positions
        met = np.zeros(len(self.ids), bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        read, depth = 0, FIRST_DEPTH
        kth = floor
        while lists:
            fresh = np.unique(np.concatenate([self.listed[a + read : min(a + read + depth, b)] for _, a, b in lists]))
            read, depth = read + depth, depth * 2
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            score = np.zeros(len(fresh), np.int64)
            for (times, a, b), marks in zip(lists, seen, strict=True):  # direct accesses
                at = a + np.searchsorted(self.doc[a:b], fresh)
                at[at == b] = a
                hit = self.doc[at] == fresh
                marks[self.position[at[hit]]] = True
                score[hit] += times * self.impact[at[hit]]
            docs.append(fresh)
            scores.append(score)
            bound = 0
            for j, (times, a, b) in enumerate(lists):
                rest = seen[j][best[j] :]
                gap = int(rest.argmin()) if len(rest) else 0
                best[j] += len(rest) if len(rest) and rest[gap] else gap
                if best[j] < b - a:
                    bound += times * int(self.falling[a + best[j]])
            found = np.concatenate(scores)
            if len(found) >= k:
                kth = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
            if bound < kth or all(read >= b - a for _, a, b in lists):
                break
        return np.concatenate(docs), np.concatenate(scores)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _blocks(batches, vocabulary, weight, documents, length):
    """ImpactLists of bounded size from a task's documents."""
    known = set(vocabulary).__contains__
    term, doc, often, norm, ids = [], [], [], [], []

    def lists():
        tf, m = np.array(often, np.int64), np.array(norm, np.int64)[np.array(doc, np.int64)]
        t = np.array(term, np.int64)
        impact = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        return ImpactLists(t, np.array(doc, np.int64), impact, np.array(ids, np.int64), len(weight))

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = terms_of(text.as_py())
            held = Counter(filter(known, words))
            if not held:
                continue
            term.extend(map(vocabulary.__getitem__, held))
            often.extend(held.values())
            doc.extend([len(ids)] * len(held))
            norm.append(75 + 25 * len(words) * documents // length)
            ids.append(NO_ID if doc_id is None else doc_id)
            if len(term) >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                yield lists()
                term, doc, often, norm, ids = [], [], [], [], []
    if ids:
        yield lists()


def _search_block(docs: DataFrame, block: list[tuple[int, int | None, Counter]], k: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    for _, _, terms in block:
        for t in terms:
            vocabulary.setdefault(t, len(vocabulary))
    documents, length, held = counts(docs, vocabulary)
    weight = weights(documents, held)
    queries = [(query, item, [(vocabulary[t], n) for t, n in terms.items()]) for query, item, terms in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        top = [(none, none)] * len(queries)
        for lists in _blocks(batches, vocabulary, weight, documents, length):
            for j, (_, _, terms) in enumerate(queries):
                ids, scores = top[j]
                floor = int(scores[-1]) if len(scores) == k else 0
                doc, score = lists.search(terms, k, floor)
                some = score >= max(1, floor)
                top[j] = _best(np.concatenate([ids, lists.ids[doc[some]]]), np.concatenate([scores, score[some]]), k)
        many = [len(ids) for ids, _ in top]
        ids = np.concatenate([none, *(ids for ids, _ in top)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([q for q, _, _ in queries], many), pa.int64()),
                pa.array([item for (_, item, _), n in zip(queries, many, strict=True) for _ in range(n)], pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(np.concatenate([none, *(scores for _, scores in top)]), pa.int64()),
            ],
            names=["query", "item_id", "doc_id", "score"],
        )

    return _texts(docs).mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    found = [_search_block(docs, block, k) for block in item_blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
