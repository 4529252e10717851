"""Toxicity scores: a lexicon learned from labels, matched with one misspelling, judged in context.

1. Terms are word beginnings that labelled toxic documents share and other
   labelled documents lack.  They are counted in Spark over a bounded sample of
   the labelled rows (``SAMPLE_ROWS``), near copies counted once.
2. The terms' trie, intersected with the Levenshtein automaton of one edit,
   becomes one table (``levenshtein``) that every word of every text runs through:
   runs of letters, and runs in which digits or signs stand for letters (signs
   that look like a letter are read as it, others cost the edit).
3. Each hit is weighed in the window of text around it: a hit inside quotation
   marks or after a word of reporting counts as quotation, one near a word of
   address counts for more.
4. A logistic regression on four sums per document (all or misspelled hits, abuse
   or quotation) and on whether each is over zero, fitted on the same sample,
   gives the score.

Defined results: a null or empty text has no hit and gets the score of such a
document; a null doc_id is scored like any other; rows that repeat are scored
each; without labelled rows of both kinds every score is 0.0; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm import letters, levenshtein, tokens
from convoscope.llm.minhash import shingles
from convoscope.llm.tables import stored

#: Labelled rows that lexicon and weights are fitted on, at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 20_000
#: Letters of the beginnings that are counted; longer words are known by their first LONGEST letters.
SHORTEST, LONGEST = 3, 16
WINDOW = 60
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
#: Words of reporting and of address (fixed values).
REPORTING = "said says quote quoted called word term wrote sagte schrieb wort dit mot écrit dijo palabra escribió".split()
ADDRESS = "you your du dich dein ihr vous tu toi votre usted tú te".split()
FEATURES = 8
#: Common insults (fixed values): so few are tried that weaker evidence in the labels admits them.
SEEDS = (
    "idiot moron stupid dumb imbecile loser trash garbage scum filth vermin pathetic worthless disgusting clown fool "
    "jerk creep coward liar idiota estúpido imbécil basura asqueroso payaso crétin débile ordure minable dégoûtant "
    "dumm trottel abschaum versager widerlich erbärmlich wertlos"
).split()


@dataclass
class Model:
    terms: list[str]
    machine: levenshtein.Automaton
    weights: np.ndarray  # bias first


def _stems(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text))


def stem_rows(sample: DataFrame) -> DataFrame:
    """(stem, docs): in how many of the sample's texts some word begins with each stem."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            count: Counter[str] = Counter()
            for text in letters.lowered(batch.column("text").to_pylist()):
                count.update(_stems(_words(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["stem", "docs"]
            )

    return sample.select("text").mapInArrow(run, "stem string, docs long").groupBy("stem").agg(F.sum("docs").alias("docs"))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text, toxic and the least of two hashes of four-word shingles: near copies share them."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            data, offsets = tokens.flat(batch.column("text"))
            out: list[list[np.ndarray]] = [[], []]
            for a, b in tokens.pieces(offsets, 2 << 20):
                keys, begin = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 4)
                for salt, least in enumerate(out):
                    mixed = np.append(tokens.mix(keys, salt) >> np.uint64(1), np.uint64(0))
                    least.append(np.where(np.diff(begin) > 0, np.minimum.reduceat(mixed, begin[:-1]), np.uint64(0)).astype(np.int64))
            out = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "sig1", "sig2"])

    return docs.mapInArrow(run, "doc_id long, text string, toxic int, sig1 long, sig2 long")


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most about SAMPLE_ROWS labelled rows, chosen by a hash of the id, with their texts."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, SAMPLE_ROWS / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # bounded by SAMPLE_ROWS, so it can be sent to every executor
    return stored(_signed(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")), "toxicity-sample")


def lexicon(sample: DataFrame) -> list[str]:
    once = stored(sample.dropDuplicates(["sig1", "toxic"]).dropDuplicates(["sig2", "toxic"]), "toxicity-once")
    n = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return []
    stems = stored(stem_rows(once.where("toxic = 1")), "toxicity-stems")
    tried = stems.count()
    base = bad / (bad + good)
    # of all stems tried, a tenth of one is expected to pass by chance
    needed = F.when(F.col("stem").isin(*SEEDS), float(np.log(10 * len(SEEDS)))).otherwise(float(np.log(10 * tried)))
    p = F.col("docs").cast("double")
    # what a stem could show at most, if no other document had it
    able = stems.where((F.col("docs") > 2) & (p * float(-np.log(base)) >= needed))
    others = stem_rows(once.where("toxic = 0")).withColumnRenamed("docs", "others")
    both = able.join(others, "stem", "left").withColumn("others", F.coalesce("others", F.lit(0)))
    n = p + F.col("others")
    # bound on minus the log of the chance that a stem without meaning looks this toxic
    rest = F.when(F.col("others") > 0, F.col("others") * F.log(F.col("others") / n / (1 - base))).otherwise(0.0)
    shown = both.where((p >= 4 * F.col("others")) & (p * F.log(p / n / base) + rest >= needed))
    pos = {r["stem"]: r["docs"] for r in shown.select("stem", "docs").collect()}
    pure = set(pos)
    # a beginning that nearly always goes on the same way gives way to the longer one
    kept = [s for s in pure if not any(t[:-1] == s and pos[t] >= 0.9 * pos[s] for t in pure if len(t) == len(s) + 1)]
    terms: list[str] = []
    for s in sorted(kept, key=lambda s: (len(s), -pos[s], s)):
        if not any(s.startswith(t) for t in terms):
            terms.append(s)
    return sorted(terms, key=lambda s: (-pos[s], s))


def context(text: str, start: int, end: int) -> tuple[bool, float]:
    """(quotation?, weight) of a hit from the window of text around it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max(before.rfind(c) for c in OPENING)
    inside = opened >= 0 and any(c in after for c in CLOSING) and not any(c in before[opened + 1 :] for c in CLOSING)
    if inside and before[opened] == '"':  # a straight mark opens only if an odd number precede
        line = text.rfind("\n", 0, start) + 1
        inside = text.count('"', line, start) % 2 == 1
    near = _words(before)
    quoted = inside or bool(near & set(REPORTING))
    return quoted, 1.5 if (near | _words(after)) & set(ADDRESS) else 1.0


def features(texts: list[str | None], machine: levenshtein.Automaton) -> np.ndarray:
    """Per text: log of one plus the weighed hits, by (all, misspelled) x (abuse, quotation),
    then 1 where there is such a hit.

    Misspelled hits count among all, so they weigh like others until labels tell otherwise."""
    low = letters.lowered(texts)
    out = np.zeros((len(low), FEATURES // 2))
    for a, b in letters.pieces(low):
        codes, starts, ends, _, offsets = letters.letter_words(low[a:b])
        kind = levenshtein.match(machine, codes, starts, ends)
        hits = np.flatnonzero(kind)
        found = list(zip(starts[hits].tolist(), ends[hits].tolist(), kind[hits].tolist(), strict=True))
        # disguised words count as misspelled, unless a run of letters in them has hit by itself
        starts, ends, folded = letters.disguised_words(codes, offsets)
        masked = np.flatnonzero(levenshtein.match(machine, folded, starts, ends))
        before = np.array([h[0] for h in found], np.int64)
        alone = np.searchsorted(before, starts[masked]) == np.searchsorted(before, ends[masked])
        found += [(s, e, levenshtein.FUZZY) for s, e in zip(starts[masked[alone]].tolist(), ends[masked[alone]].tolist(), strict=True)]
        text_of = np.searchsorted(offsets, [h[0] for h in found], side="right") - 1
        for (s, e, how), k in zip(found, text_of.tolist(), strict=True):
            quoted, weight = context(low[a + k], s - int(offsets[k]), e - int(offsets[k]))
            out[a + k, int(quoted)] += weight
            if how == levenshtein.FUZZY:
                out[a + k, 2 + quoted] += weight
    return np.hstack([np.log1p(out), out > 0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.001, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the bias comes first and is not shrunk.
    The ridge is per row, so the fit doesn't depend on the sample's size."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    loss = lambda w: np.mean(np.logaddexp(0, x @ w) - y * (x @ w)) + 0.5 * w @ shrink @ w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) / len(x) + shrink @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + shrink, slope)
        scale = 1.0
        while loss(w - scale * move) > loss(w) and scale > 1e-6:
            scale /= 2
        w = w - scale * move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from docs(doc_id, text) and labels(doc_id, toxic)."""
    sample = sample_rows(docs.select("doc_id", "text"), labels)
    terms = lexicon(sample)
    machine = levenshtein.compile_trie(terms)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = features(batch.column("text").to_pylist(), machine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *(pa.array(x[:, k]) for k in range(FEATURES))], ["toxic", *(f"x{k}" for k in range(FEATURES))]
            )

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES)))
    # one row of numbers per distinct pattern: bounded by SAMPLE_ROWS
    got = rows.groupBy(*rows.columns).count().orderBy(*rows.columns).collect()
    y = np.repeat([r["toxic"] for r in got], [r["count"] for r in got]).astype(float)
    if len(set(y.tolist())) < 2:
        return Model([], levenshtein.compile_trie([]), np.array([-np.inf] + [0.0] * FEATURES))
    x = np.repeat([[r[f"x{k}"] for k in range(FEATURES)] for r in got], [r["count"] for r in got], axis=0)
    return Model(terms, machine, logistic(x, y))


def _scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    x = features(texts, model.machine)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(model.weights[0] + x @ model.weights[1:]))), x


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, abuse, quotation (logs of one plus the weighed hits)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            score, x = _scores(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(x[:, 0]), pa.array(x[:, 1])],
                ["doc_id", "score", "abuse", "quotation"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, abuse double, quotation double")


def without_toxic(docs: DataFrame, model: Model, reject_at: float = 0.7) -> DataFrame:
    """docs(text, ...) without the rows that score ``reject_at`` or more; all columns stay."""
    at = docs.columns.index("text")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            score, _ = _scores(batch.column(at).to_pylist(), model)
            yield batch.filter(pa.array(score < reject_at))

    return docs.mapInArrow(run, docs.schema)
