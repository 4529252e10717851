import random
import re
import zlib

import numpy as np
import pytest

from convoscope.llm import langid_crf, levenshtein, queries, toxicity
from tests.llm.odd import LANGS, SCHEMA, odd_docs, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def one_edit_inside(term, alphabet):
    """What a term becomes by one edit that leaves its first and last letter in place."""
    out = {term[:i] + term[i + 1 :] for i in range(1, len(term) - 1)}
    out |= {term[:i] + c + term[i + 1 :] for i in range(1, len(term) - 1) for c in alphabet}
    return out | {term[:i] + c + term[i:] for i in range(1, len(term)) for c in alphabet}


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "scum", "vermin", "abcab"]
    machine = levenshtein.compile_trie(terms)
    words = ["".join(rng.choice("abcdimorntscuve") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for t in terms:
        words += [t, t + "s", t[1:], t[:-1], t[:2] + "x" + t[2:], t[:2] + "x" + t[3:], t[0] + t]
        words += [t[:2] + "x" + t[2:] + "ic", t[:2] + "x" + t[3:] + "ic", t[:2] + t[3:] + "ic", t[:-1] + "ing", "x" + t[1:] + "ic"]
    text = " ".join(words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    got = levenshtein.match(machine, codes, *(np.array(x) for x in zip(*found, strict=True)))
    inner = {t: one_edit_inside(t, set("".join(words))) for t in terms}
    for w, kind in zip(words, got.tolist(), strict=True):
        exact = any(w.startswith(t) for t in terms)
        near = any(len(t) >= 5 and (edits(w, t) == 1 or any(w.startswith(b) for b in inner[t])) for t in terms)
        assert kind == (levenshtein.EXACT if exact else levenshtein.FUZZY if near else levenshtein.NONE), w


def test_disguised_words_hit():
    machine = levenshtein.compile_trie(["idiot", "stupid"])
    hit = "id1ot st*pid idiiotic 1d1ot !diot stup!d $tupid foo.idiot hey!stupid idi0t idiotic ID1OT".split()
    clean = "id st 1.5 a-b 2019-10-11 idiomatic lower s-t-u-p-i-d-x i.e. x*y*z pid stu_dy well-known".split()
    rows = [*hit, *clean, None, "", "*", "1"]
    found = toxicity.features(rows, machine)[:, :4].sum(axis=1) > 0
    assert [w for w, x in zip(rows, found, strict=True) if x] == hit
    # each word of a longer text is found at its own place, and counts once
    both = toxicity.features(["st*pid and id1ot", "no", "idiot", "foo.idiot"], machine)
    assert np.allclose(np.expm1(both[:, :4]), [[2, 0, 2, 0], [0, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]])


def test_quotation_is_told_from_abuse():
    assert toxicity.context('he wrote "idiot" on it', 10, 15)[0]
    assert toxicity.context("they said the word idiot", 19, 24)[0]
    assert not toxicity.context('a "fine" day and idiot', 17, 22)[0]
    assert toxicity.context("you are an idiot", 11, 16) == (False, 1.5)


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts hold made-up stems of their own, one of them sometimes misspelled."""
    rng = random.Random(4)
    rows = []
    for k in range(600):
        words = prose(rng, 80).split()
        toxic = int(k % 6 == 0)
        if toxic:
            for stem in rng.sample(["zorblat", "quixem", "vrunto"], 2):
                words.insert(rng.randrange(80), stem + rng.choice(["", "ed", "ish"]))
        rows.append((k, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)


def test_toxicity_learns_its_lexicon(spark, labelled):
    model = toxicity.fit(labelled.select("doc_id", "text"), labelled.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    assert set(model.terms) == {"zorblat", "quixem", "vrunto"}
    got = {r.doc_id: r.score for r in toxicity.toxicity(labelled, model).collect()}
    truth = {r.doc_id: r.toxic for r in labelled.collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y in truth.items() if i % 3 == 1)
    odd = toxicity.toxicity(odd_docs(spark), model).collect()
    assert len(odd) == odd_docs(spark).count() and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.without_toxic(labelled, model)
    assert kept.columns == labelled.columns and {r.toxic for r in kept.collect()} == {0}
    # misspelled and disguised terms alone, though the labels hold none
    spelled = spark.createDataFrame([(1, "a zorbblat and quixxemed here"), (2, "vrunt0 and z*rblat")], "doc_id long, text string")
    assert all(r.abuse > 0 and r.score >= 0.7 for r in toxicity.toxicity(spelled, model).collect())


def test_toxicity_without_labels_scores_zero(spark, labelled):
    model = toxicity.fit(labelled, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.toxicity(labelled, model).collect()} == {0.0}
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    counts = np.array([4, 1, 2])
    gamma, expected = langid_crf.forward_backward(scores, counts, moves, pairs=True)
    want, pairs, a = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for n in counts:
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        w = np.array([np.exp(sum(scores[a + t, y] for t, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w, strict=True):
            for t, y in enumerate(p):
                want[a + t, y] += x
            for y, z in zip(p, p[1:], strict=False):
                pairs[y, z] += x
        a += n
    assert np.allclose(gamma, want) and np.allclose(expected, pairs)


def test_segments_of_long_chains_equal_the_whole_chain(monkeypatch):
    rng = np.random.default_rng(1)
    counts = np.array([3, 95, 1, 40, 7, 8, 14])
    scores, moves = rng.normal(size=(counts.sum(), 4)) * 2, rng.normal(size=(4, 4))
    want = langid_crf.forward_backward(scores, counts, moves)
    for size in (1, 7, 13, 94):
        monkeypatch.setattr(langid_crf, "SEGMENT", size)
        assert np.allclose(langid_crf.forward_backward(scores, counts, moves), want)
    monkeypatch.setattr(langid_crf, "SEGMENT", 1_024)
    long = np.array([300_000])  # no sum runs away, and no step for each word
    gamma = langid_crf.forward_backward(rng.normal(size=(300_000, 3)).astype(np.float32) * 5, long, moves[:3, :3])
    assert np.allclose(gamma.sum(axis=1), 1, atol=1e-5)


def test_training_words_come_from_the_whole_text():
    words = [f"w{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(5_000)]
    got = [words.index(w) for w in langid_crf.drawn_words(" ".join(words)).split()]
    assert len(got) == langid_crf.SAMPLE_BLOCKS * langid_crf.HALF and got == sorted(got)
    assert got[0] < 2_000 and got[-1] > 3_000 and all(k - k % 25 in got for k in got)
    assert langid_crf.drawn_words(" ".join(words[:390])) == " ".join(words[:390])
    assert langid_crf.drawn_words("") == "" == langid_crf.drawn_words(" 12 ")


def plain_shares(text, model):
    """Mean language probabilities of a text, word by word in plain Python."""
    mask, k = (1 << 64) - 1, len(model.languages)
    slot = lambda x, kind: ((x + kind) * 0x9E3779B97F4A7C15 & mask) >> 48
    three = lambda a, b, c: (a * 0x110000 + b) * 0x110000 + c & mask
    found = [[ord(c) for c in m] for m in re.findall(r"[^\W\d_]+", text.lower())]
    scores = []
    for w in found:
        table = langid_crf.tokens.powers(langid_crf.tokens.WORD_BASE, len(w))
        word = sum(int(x) for x in langid_crf.tokens.mix(np.array(w, np.uint64)) * table[: len(w)]) & mask
        pad, front, back = [0, *w, 0], [*w, 0, 0], [*w[::-1], 0, 0]
        slots = [slot(three(*pad[i : i + 3]), 1) for i in range(len(w))]
        slots += [slot(three(*front[:3]), 2), slot(three(*back[:3]), 3), slot(word, 4)]
        scores.append(model.weights[slots].astype(float).sum(axis=0))
    move = np.exp(model.moves.astype(float))
    ahead, behind = [np.exp(scores[0])], [np.ones(k)]
    for x in scores[1:]:
        ahead.append(ahead[-1] / ahead[-1].sum() @ move * np.exp(x))
    for x in scores[:0:-1]:
        behind.append(move @ (np.exp(x) * behind[-1] / behind[-1].sum()))
    each = [a * b / (a * b).sum() for a, b in zip(ahead, behind[::-1], strict=True)]
    return dict(zip(model.languages, np.mean(each, axis=0), strict=True))


def test_language_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid_crf.fit(docs.where(queries._remainder(4) != 2))
    got = {r.doc_id: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    learned = {r.lang for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    for r in rows:
        out = got[r.doc_id]
        assert out.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (out.lang_pred, out.score) == ("und", 0.0)
            continue
        shares = plain_shares(r.text, model)
        assert out.lang_pred in learned and abs(out.score - max(shares.values())) < 1e-3
        assert shares[out.lang_pred] > max(shares.values()) - 1e-3


def test_language_id_on_held_out_and_switched_text(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(20, 60), lang), lang) for k in range(300) for lang in [rng.choice(list(LANGS))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid_crf.fit(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.lang_pred for r in langid_crf.predict(docs, model).collect()}
    assert np.mean([got[k] == lang for k, _, lang in rows if k % 4 == 2]) > 0.95
    mixed = spark.createDataFrame([(1, prose(rng, 60, "de") + " " + prose(rng, 20, "en"))], "doc_id long, text string")
    row = langid_crf.predict(mixed, model).first()
    assert row.lang_pred == "de" and 0.1 < row.shares["en"] < 0.45
    odd = {r.doc_id: r for r in langid_crf.predict(odd_docs(spark), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0.0 for i in (500, 501, 502, 509))
    assert odd[503].lang_pred in LANGS


def test_language_id_without_labels(spark):
    model = langid_crf.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid_crf.predict(odd_docs(spark), model).collect()} == {"und"}
    assert langid_crf.predict(spark.createDataFrame([], SCHEMA), model).collect() == []
