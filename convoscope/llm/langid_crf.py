"""Language of code-switched text by a linear-chain conditional random field over words.

Each run of letters is a word with features: every letter trigram with its word
boundaries (the outer ones are the shortest affixes), the three-letter prefix
and suffix, and the whole word as an entry of a hashed lexicon.  Features hash
into one weight table; transitions between neighbouring words' languages are
learned with it by gradient steps on the chain's log-likelihood.  Forward-
backward gives each word's language probabilities over the whole text, and the
text's language is the one with the largest sum over its words.

Training sequences splice words of two labelled texts, so that transitions see
switches; texts and labels of a bounded sample (``SAMPLE_ROWS``) are read, the
rest of the rows only predicted.  A sampled text gives blocks of neighbouring
words, drawn over its whole length by a hash.

A long text is cut into segments.  A segment's effect on the chain is one
languages x languages matrix; these are made for all segments in step, carried
from segment to segment in both directions, and every segment then runs on its
own from exactly the state that the whole chain has there.

Defined results: a null text, or one without letters, is ``und`` with score
0.0; a null doc_id is predicted like any other; rows that repeat are predicted
each; without labelled rows everything is ``und``; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import letters, tokens
from convoscope.llm.tables import stored

#: Labelled rows fitted on, at most (about; chosen by a hash of the id), and the blocks of words drawn from each.
SAMPLE_ROWS = 2_000
SAMPLE_BLOCKS = 16
SLOTS = 1 << 16
HALF = 25  # words of a block: one text's share of a training sequence
CHAINS = 200  # sequences in a gradient step
SEGMENT = 1_024  # words of a long text that are stepped through one by one
EPOCHS, RATE, RIDGE = 12, 0.3, 1e-6


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slot, language
    moves: np.ndarray  # language, next language (log potentials)


def word_slots(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigram around each letter (with each word's first), and of prefix, suffix and word."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first - starts, n)
    here = codes[at].astype(np.uint64)
    begins, ends_at = np.zeros(len(at), bool), np.zeros(len(at), bool)
    begins[first], ends_at[first + n - 1] = True, True
    left, right = np.roll(here, 1), np.roll(here, -1)
    left[begins], right[ends_at] = 0, 0

    def slot(x: np.ndarray, kind: int) -> np.ndarray:
        return ((x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32)

    tri = slot((left * np.uint64(0x110000) + here) * np.uint64(0x110000) + right, 1)
    letter = lambda k: np.where(k < ends, codes[np.minimum(k, ends - 1)], 0).astype(np.uint64)
    prefix = (letter(starts) * np.uint64(0x110000) + letter(starts + 1)) * np.uint64(0x110000) + letter(starts + 2)
    back = lambda k: np.where(k >= starts, codes[np.maximum(k, starts)], 0).astype(np.uint64)
    suffix = (back(ends - 1) * np.uint64(0x110000) + back(ends - 2)) * np.uint64(0x110000) + back(ends - 3)
    place = np.arange(len(at)) - np.repeat(first, n)
    table = tokens.powers(tokens.WORD_BASE, int(n.max()) if len(n) else 1)
    word = np.add.reduceat(tokens.mix(here) * table[place], first) if len(n) else np.zeros(0, np.uint64)
    return tri, first, np.stack([slot(prefix, 2), slot(suffix, 3), slot(word, 4)], axis=1)


def emissions(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials (word, language) of all words, and the number of words of each text."""
    parts, counts = [], []
    for a, b in letters.pieces(texts):
        codes, starts, ends, begin, _ = letters.letter_words(texts[a:b])
        counts.append(np.diff(begin))
        if len(starts):
            tri, first, whole = word_slots(codes, starts, ends)
            parts.append(np.add.reduceat(weights[tri], first, axis=0) + weights[whole].sum(axis=1))
    k = weights.shape[1]
    return np.concatenate(parts) if parts else np.zeros((0, k), weights.dtype), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def in_step(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chains from long to short, where each begins, and how many hold a word t, for every t."""
    order = np.argsort(-counts, kind="stable")
    length = counts[order]
    longest = int(length[0]) if len(length) else 0
    return order, (np.cumsum(counts) - counts)[order], np.searchsorted(-length, -np.arange(longest), side="left")


def carried(near: np.ndarray, move: np.ndarray, chains: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each segment from the words before it and from those after it (its first and last word's factors).

    ``chains``: the number of segments of each chain; ``segments``: words of each segment.
    """
    k = move.shape[0]
    order, begin, active = in_step(segments)
    effect = np.broadcast_to(np.eye(k, dtype=near.dtype), (len(segments), k, k)).copy()
    for t, m in enumerate(active):
        effect[:m] = (effect[:m] if t == 0 else effect[:m] @ move) * near[begin[:m] + t][:, None, :]
        effect[:m] /= effect[:m].sum(axis=(1, 2), keepdims=True)
    effect[order] = effect.copy()
    before, after = np.ones((len(segments), k), near.dtype), np.ones((len(segments), k), near.dtype)
    for end, n in zip(np.cumsum(chains).tolist(), chains.tolist(), strict=True):
        for s in range(end - n + 1, end):
            before[s] = (before[s - 1] @ effect[s - 1]) @ move
            before[s] /= before[s].sum()
        for s in range(end - 2, end - n - 1, -1):
            after[s] = move @ (effect[s + 1] @ after[s + 1])
            after[s] /= after[s].sum()
    return before, after


def forward_backward(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Language probabilities of every word of chains laid end to end, all chains in step.

    With ``pairs`` (of short chains) also the expected number of each transition.
    """
    k = moves.shape[0]
    near = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves).astype(near.dtype)
    entering = leaving = np.ones((len(counts), k), near.dtype)
    if not pairs and len(counts) and counts.max() > SEGMENT:
        chains = -(-counts // SEGMENT)
        last = np.cumsum(chains) - 1
        segments = np.full(int(chains.sum()), SEGMENT, np.int64)
        segments[last] = counts - (chains - 1) * SEGMENT
        entering, leaving = carried(near, move, chains, segments)
        counts = segments
    order, begin, active = in_step(counts)
    longest = len(active)
    every = np.ones((k, 1), near.dtype)  # a product with it sums a row
    entering, leaving = entering[order], leaving[order]
    alpha = np.empty_like(near)
    state = None
    for t in range(longest):
        at = begin[: active[t]] + t
        state = (entering if t == 0 else state[: active[t]] @ move) * near[at]
        state /= state @ every
        alpha[at] = state
    gamma = np.empty_like(near)
    expected = np.zeros((k, k))
    beta = np.ones((0, k), near.dtype)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        if t + 1 < longest:
            later = active[t + 1]
            message = near[begin[:later] + t + 1] * beta[:later]
            if pairs:
                state = alpha[at[:later]]
                expected += move * (state.T @ (message / ((state @ move * message) @ every)))
            beta = message @ move.T
            beta /= beta @ every
            if m > later:
                beta = np.concatenate([beta, leaving[later:m]])
        else:
            beta = leaving[:m]
        g = alpha[at] * beta
        gamma[at] = g / (g @ every)
    return (gamma, expected) if pairs else gamma


def sequences(texts: list[str], labels: np.ndarray, seed: int = 7):
    """Training chains: HALF words of one text, then HALF of another, in a fixed random order."""
    codes, starts, ends, begin, _ = letters.letter_words(texts)
    blocks = [(a, min(a + HALF, e), y) for s, e, y in zip(begin[:-1], begin[1:], labels, strict=True) for a in range(int(s), int(e), HALF)]
    np.random.default_rng(seed).shuffle(blocks)
    words = np.concatenate([np.arange(a, b) for a, b, _ in blocks]) if blocks else np.zeros(0, np.int64)
    truth = np.concatenate([np.full(b - a, y) for a, b, y in blocks]).astype(np.int64) if blocks else np.zeros(0, np.int64)
    sizes = np.array([b - a for a, b, _ in blocks], np.int64)
    counts = np.add.reduceat(sizes, np.arange(0, len(sizes), 2)) if len(sizes) else sizes
    return codes, starts[words], ends[words], truth, counts


def train(texts: list[str], langs: list[str]) -> Model:
    """Adagrad on the chains' log-likelihood, CHAINS sequences a step; a step touches only slots that occur in it."""
    languages = sorted(set(langs))
    k = len(languages)
    weights, moves = np.zeros((SLOTS, k)), np.zeros((k, k))
    codes, starts, ends, truth, counts = sequences(letters.lowered(texts), np.array([languages.index(x) for x in langs]))
    if not len(truth):
        return Model([], np.zeros((SLOTS, 1), np.float32), np.zeros((1, 1), np.float32))
    tri, first, whole = word_slots(codes, starts, ends)
    n = np.append(first[1:], len(tri)) - first
    seen_w, seen_m = np.full((SLOTS, k), 1e-8), np.full((k, k), 1e-8)
    edges = np.concatenate([[0], np.cumsum(counts)])
    steps = []
    for g in range(0, len(counts), CHAINS):  # a step's slots, once each, and where its features stand among them
        chain = counts[g : g + CHAINS]
        a, b = edges[g], edges[g + len(chain)]
        t0, t1 = first[a], first[b] if b < len(first) else len(tri)
        slots, place = np.unique(np.concatenate([tri[t0:t1], whole[a:b].ravel()]), return_inverse=True)
        word = np.concatenate([np.repeat(np.arange(b - a), n[a:b]), np.repeat(np.arange(b - a), whole.shape[1])])
        inside = np.ones(b - a, bool)
        inside[edges[g : g + len(chain)] - a] = False
        steps.append((chain, truth[a:b], slots, place, word, np.flatnonzero(inside)))
    for _ in range(EPOCHS):
        for chain, y, slots, place, word, at in steps:
            now = weights[slots]
            scores = np.stack([np.bincount(word, now[place, j], len(y)) for j in range(k)], axis=1)
            gamma, expected = forward_backward(scores, chain, moves, pairs=True)
            gamma[np.arange(len(y)), y] -= 1
            slope = np.stack([np.bincount(place, gamma[word, j], len(slots)) for j in range(k)], axis=1)
            np.add.at(expected, (y[at - 1], y[at]), -1.0)
            slope = slope / len(y) + RIDGE * now
            expected /= len(y)
            seen_w[slots] += slope**2
            seen_m += expected**2
            weights[slots] = now - RATE * slope / np.sqrt(seen_w[slots])
            moves -= RATE * expected / np.sqrt(seen_m)
    return Model(languages, weights.astype(np.float32), moves.astype(np.float32))


def drawn_words(text: str) -> str:
    """Words of SAMPLE_BLOCKS blocks of a lower-cased text (all, if it has no more), in the text's order."""
    _, starts, ends, _, _ = letters.letter_words([text])
    blocks = -(-len(starts) // HALF)
    chosen = np.arange(blocks)
    if blocks > SAMPLE_BLOCKS:
        chosen = np.sort(np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).choice(blocks, SAMPLE_BLOCKS, replace=False))
    words = [(a, b) for c in chosen.tolist() for a, b in zip(starts[c * HALF : (c + 1) * HALF].tolist(), ends[c * HALF : (c + 1) * HALF].tolist(), strict=True)]
    return " ".join(text[a:b] for a, b in words)


def fit(labelled: DataFrame) -> Model:
    """Model from labelled(doc_id, text, lang); reads about SAMPLE_ROWS rows, chosen by a hash of the id."""
    labelled = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, SAMPLE_ROWS / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:  # only the words that training reads travel
            texts = [drawn_words(text) for text in letters.lowered(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang")], ["doc_id", "words", "lang"])

    rows = chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, words string, lang string")
    rows = stored(rows, "language-sample").orderBy("doc_id", "lang", "words").collect()
    return train([r["words"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score (mean probability of that language over
    the text's words), shares (map of every language's)."""
    names, weights, moves = model.languages, model.weights, model.moves

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = letters.lowered(batch.column("text").to_pylist())
            scores, counts = emissions(texts, weights)
            some = counts > 0
            mean = np.zeros((len(texts), weights.shape[1]))
            if len(names) and some.any():
                gamma = forward_backward(scores, counts[some], moves)
                begin = np.cumsum(counts[some]) - counts[some]
                mean[some] = np.add.reduceat(gamma, begin, axis=0, dtype=np.float64) / counts[some][:, None]
            else:
                some = np.zeros(len(texts), bool)
            best = mean.argmax(axis=1)
            pred = [names[j] if ok else "und" for j, ok in zip(best.tolist(), some.tolist(), strict=True)]
            shares = [list(zip(names, row, strict=False)) if ok else [] for row, ok in zip(mean.tolist(), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(pred, pa.string()),
                    pa.array(np.clip(mean[np.arange(len(texts)), best], 0, 1)),
                    pa.array(shares, pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")
