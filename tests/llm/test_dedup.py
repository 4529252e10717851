import hashlib
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.llm import batches, lyndon, minhash, substring_dedup, suffix_dedup
from convoscope.llm.components import components
from tests.llm.odd import SCHEMA, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(rows):
    return Counter(rows)


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 1 << 13)
    monkeypatch.setattr(batches, "BUCKET_HASHES", 500)


def test_grouping_construction_sorts_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(150):
        texts = [bytes(rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        codes = np.concatenate([np.concatenate([[0], np.frombuffer(t, np.uint8).astype(int) + 2, [0]]) for t in texts])
        size = np.array([len(t) + 1 for t in texts])
        low = np.cumsum(size + 1) - (size + 1)
        out = lyndon.suffix_order(codes, low, size)
        for t, a, n in zip(texts, low, size, strict=True):
            assert (out[a + 1 : a + 1 + n] - a - 1).tolist() == sorted(range(n), key=lambda i, t=t: t[i:])


def brute_bytes(rows, width):
    """Smallest id of every window; a window goes if that is below the document's own."""
    last = 1 << 63
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            least[w] = min(least.get(w, last), last - 1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < (last - 1 if i is None else i):
                gone[k] += 1
                gone[k + width] -= 1
        m = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
        out.append((i, len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot,crowd", [(1000, 32), (2, 1)])
def test_suffix_dedup_equals_brute_force(spark, small_batches, monkeypatch, hot, crowd):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 13)
    got = suffix_dedup.remove_repeats(odd_docs(spark), 50).collect()
    rows = [
        (r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got
    ]
    assert Counter(rows) == brute_bytes(odd_rows(), 50)


def brute_words(rows, width):
    seen = Counter()
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("width", [35, 3, 1])
def test_window_dedup_equals_brute_force(spark, small_batches, width):
    got = substring_dedup.remove_repeated_windows(odd_docs(spark), width).collect()
    rows = [(r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), r.kept) for r in got]
    assert Counter(rows) == brute_words(odd_rows(), width)
    assert all(a.end < b.begin for r in got for a, b in zip(r.spans, r.spans[1:], strict=False))  # maximal


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_groups(rows, percent):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None and shingle_set(t):
            sets[i].append(shingle_set(t))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates_equal_brute_force(spark, percent):
    got = minhash.near_duplicates(odd_docs(spark), percent).collect()
    groups = brute_groups(odd_rows(), percent)
    expected = Counter(
        (i, len(shingle_set(t)), None if i is None else groups.get(i, i), True if i is None else groups.get(i, i) == i)
        for i, t, *_ in odd_rows()
    )
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


def test_one_document_of_each_group_stays(spark):
    kept = minhash.without_near_duplicates(odd_docs(spark), 85)
    assert kept.columns == odd_docs(spark).columns
    rows = kept.collect()
    groups = brute_groups(odd_rows(), 85)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(ids) == sorted({i for i, *_ in odd_rows() if i is not None and groups.get(i, i) == i})


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).collect() == []
    assert substring_dedup.remove_repeated_windows(none).collect() == []
    assert minhash.near_duplicates(none).collect() == []


def test_densification_fills_every_bin():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 3).astype(np.uint64) << np.uint64(1))
    filled = minhash.signatures(keys, np.array([0, 3, 3]))
    assert set(filled[0].tolist()) == set(keys.tolist())
    assert (filled[1] == minhash.EMPTY).all()


def test_pairs_inside_a_family_of_look_alikes_are_found(spark, monkeypatch):
    """All texts share one bucket, whose first centres link to nothing."""
    rng = np.random.default_rng(8)
    common = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
    rows = [(k, " ".join([*common, *(f"w{rng.integers(1 << 40)}" for _ in range(60))])) for k in range(30)]
    rows += [(1000, " ".join(common)), (1001, " ".join(common[:192])), (1002, rows[20][1] + " end")]
    sketches = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a: sketches(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows, 85)
    assert {i: c for i, c in got.items() if c != i} == {1001: 1000, 1002: 20}


def test_a_large_family_of_look_alikes(spark, monkeypatch):
    """5,000 edited copies of one text, each far from every other; a few have an edited copy of their own."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    rows, alike = [(0, " ".join(base))], {}
    for k in range(1, 5001):
        words = list(base)
        for at in rng.choice(30, 5, replace=False) * 5:
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
        if k % 250 == 0:
            words[3] += "more"
            alike[10_000 + k] = k
            rows.append((10_000 + k, " ".join(words)))
    written, stored = {}, minhash.stored

    def counting(df, name):
        out = stored(df, name)
        written.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 85).collect()
    assert {r.doc_id: r.component_id for r in got if not r.kept} == alike
    assert sum(p.count() for p in written["pairs"]) <= 30 * len(rows)  # about 12,500,000 pairs in all


def test_few_tables_are_written(spark, monkeypatch):
    """Each table costs a stage over all partitions, however few its rows: at most two a round, two for the components."""
    rng = np.random.default_rng(12)
    common = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
    rows = [(k, " ".join([*common, *(f"w{rng.integers(1 << 40)}" for _ in range(60))])) for k in range(20)]
    rows += [(100 + k, f"{rows[0][1]} end{k}") for k in range(5)] + [(200, rows[9][1] + " end")]
    sketches, stored, written = minhash.sketches, minhash.stored, Counter()
    monkeypatch.setattr(minhash, "sketches", lambda *a: sketches(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))

    def counting(df, name):
        written[name] += 1
        return stored(df, name)

    for module in (minhash, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "stored", counting)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows, 85)
    assert got[104] == 0 and got[200] == 9
    rounds = written["pairs"] - 1  # the last ones are those across buckets
    assert rounds >= 1 and written["buckets"] <= rounds and written["edges"] <= 2
    assert sum(written.values()) <= 2 * rounds + 10


def test_pairs_are_judged_on_full_sets(spark):
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in (1, 4, 5, 30, 30, 300)]
    rows = list(enumerate(texts)) + [(6, texts[5] + " x"), (7, texts[3] + " " + texts[3])]
    sets = minhash.full_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "centre long, node long")
    of = {i: shingle_set(t) for i, t in rows}
    for percent in (20, 50, 99):
        got = {(r.centre, r.node) for r in minhash.judged(pairs, sets, percent).where("same").collect()}
        assert got == {(a, b) for a in of for b in of if a < b and 100 * len(of[a] & of[b]) >= percent * len(of[a] | of[b])}


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_bands_keep_to_the_loss(percent):
    assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent) <= minhash.LOSS
    assert minhash.bands_for(85) == minhash.BANDS
