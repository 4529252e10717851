"""Exact top-k inner products by best-first search in M-trees.

Vectors are dealt by id into blocks of a bounded number of rows; each block is
an M-tree of pages.  Inner products become distances by one more coordinate
(every vector is lifted to the block's largest norm), so the nearest vectors
are those with the largest product.  A page stores its routing vector, its
covering radius and its distance to the routing vector above; a vector stores
its distance to its page's.  A query visits pages by their best possible score;
the triangle inequality on stored distances skips pages and vectors before any
distance is computed, and the search ends when no page can beat the k-th score.
Scores are integers, computed exactly for the vectors that remain, in 64-bit or
Python integers where doubles would round; bounds carry a margin for rounding.

Queries meet every block, in batches of a bounded number; each (block, batch)
keeps k per query and the last step takes the k best of those.

Defined results: null vectors, empty ones, and those with a null or non-finite
component take no part; vectors meet those of the same length only; null ids
take no part; a query never meets rows of its own id; ties go to smaller ids;
fewer than k candidates give all; no rows give no rows; a score beyond 64 bits raises.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4_096
QUERY_ROWS = 4_096
PAGE, FANOUT = 512, 8
RESULT = "query_id long, vec_id long, score long"


class MTree:
    """Pages in arrays; page 0 is the root.  ``points`` are the lifted vectors."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.route: list[np.ndarray] = []
        self.radius: list[float] = []
        self.above: list[float] = []  # distance of a page's routing vector to its parent's
        self.children: list[np.ndarray] = []  # pages below, empty for a leaf
        self.rows: list[np.ndarray] = []  # vectors of a leaf
        self.reach: list[np.ndarray] = []  # their distances to the leaf's routing vector
        self._build(np.arange(len(points)), points.mean(axis=0), 0.0)
        self.above_of, self.radius_of = np.array(self.above), np.array(self.radius)
        self.routes = np.array(self.route)

    def _build(self, rows: np.ndarray, route: np.ndarray, above: float) -> int:
        page = len(self.route)
        reach = np.linalg.norm(self.points[rows] - route, axis=1)
        self.route.append(route)
        self.radius.append(float(reach.max(initial=0.0)))
        self.above.append(above)
        none = np.zeros(0, np.int64)
        self.children.append(none)
        self.rows.append(rows if len(rows) <= PAGE else none)
        self.reach.append(reach)
        if len(rows) > PAGE:
            below = [self._build(rows[part], r, float(np.linalg.norm(r - route))) for part, r in self._split(rows, reach)]
            self.children[page] = np.array(below)
        return page

    def _split(self, rows: np.ndarray, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Parts around routing vectors far from each other; equal vectors are cut evenly."""
        picked = [int(reach.argmax())]
        near = np.linalg.norm(self.points[rows] - self.points[rows[picked[0]]], axis=1)
        owner = np.zeros(len(rows), np.int64)
        while len(picked) < FANOUT and near.max() > 0:
            picked.append(int(near.argmax()))
            gap = np.linalg.norm(self.points[rows] - self.points[rows[picked[-1]]], axis=1)
            closer = gap < near
            owner[closer], near[closer] = len(picked) - 1, gap[closer]
        if len(picked) == 1:
            return [(part, self.points[rows[part[0]]]) for part in np.array_split(np.arange(len(rows)), FANOUT)]
        parts = [np.flatnonzero(owner == k) for k in range(len(picked))]
        return [(part, self.points[rows[part]].mean(axis=0)) for part in parts if len(part)]


def exact(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the number type in which their products are exact: doubles below 2**53, then
    64-bit integers, then Python integers."""
    reach = max(abs(int(x)) for x in (vectors.max(), vectors.min())) * max(abs(int(x)) for x in (queries.max(), queries.min()))
    reach *= vectors.shape[1]
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
    return vectors.astype(kind), queries.astype(kind)


def search(
    tree: MTree, vectors: np.ndarray, ids: np.ndarray, lift: float, asked: np.ndarray, own: int, k: int
) -> list[tuple[int, int]]:
    """The k best (score, id) of one block for one query; ``vectors`` and ``asked`` from ``exact``."""
    query = asked.astype(np.float64)
    norm = float(query @ query)
    point = np.append(query, 0.0)
    slack = 1e-9 * (norm + lift) + 1e-6

    def best_score(gap: np.ndarray) -> np.ndarray:
        """Largest product of a vector at least ``gap`` away."""
        return (norm + lift - np.maximum(gap, 0.0) ** 2) / 2 + slack

    held: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
    start = float(np.linalg.norm(point - tree.routes[0]))
    todo = [(-float(best_score(np.float64(start - tree.radius_of[0]))), 0, start)]
    while todo:
        bound, page, gap = heapq.heappop(todo)
        if len(held) == k and -bound < held[0][0]:
            break
        below = tree.children[page]
        if len(below):
            if len(held) == k:  # by stored distances alone
                could = best_score(np.abs(gap - tree.above_of[below]) - tree.radius_of[below])
                below = below[could >= held[0][0]]
            gaps = np.linalg.norm(tree.routes[below] - point, axis=1)
            bounds = best_score(gaps - tree.radius_of[below])
            for b, p, g in zip(bounds.tolist(), below.tolist(), gaps.tolist(), strict=True):
                if len(held) < k or b >= held[0][0]:
                    heapq.heappush(todo, (-b, p, g))
            continue
        rows = tree.rows[page]
        if len(held) == k:
            rows = rows[best_score(np.abs(gap - tree.reach[page])) >= held[0][0]]
        scores, found = vectors[rows] @ asked, ids[rows]
        others = found != own
        scores, found = scores[others], found[others]
        if len(scores) > k:  # no more of a page can enter
            best = np.argsort(found, kind="stable")
            best = best[np.argsort(-scores[best], kind="stable")][:k]
            scores, found = scores[best], found[best]
        for score, i in zip(scores.tolist(), found.tolist(), strict=True):
            entry = (int(score), -i)
            if len(held) < k or entry > held[0]:
                heapq.heappushpop(held, entry) if len(held) == k else heapq.heappush(held, entry)
    return [(s, -i) for s, i in held]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """vectors(vec_id, vector array<long>) -> query_id, rank (from 1), vec_id, score, over all rows."""
    v = F.col("vector")
    usable = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    rows = vectors.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked")).where(usable)
    rows = rows.withColumn("dim", F.size("vector"))
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    spread = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("long")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    held = rows.select("dim", spread(blocks, 1).alias("block"), every(chunks).alias("chunk"), "vec_id", "vector")
    asks = rows.where("asked").select("dim", every(blocks).alias("block"), spread(chunks, 2).alias("chunk"), "vec_id", "vector")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            dim = key[0].as_py()
            matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            held_, asked = exact(matrix(left), matrix(right))
            base, ids = matrix(left).astype(np.float64), left["vec_id"].to_numpy()
            norms = (base**2).sum(axis=1)
            lift = float(norms.max())
            tree = MTree(np.hstack([base, np.sqrt(lift - norms)[:, None]]))
            for q, own in zip(asked, right["vec_id"].to_pylist(), strict=True):
                found += [(own, i, s) for s, i in search(tree, held_, ids, lift, q, own, k)]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    by = ["dim", "block", "chunk"]
    found = held.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
