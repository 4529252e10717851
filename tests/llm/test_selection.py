import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from convoscope.llm import decontaminate, mixing, mtree, secret_ledger, url_filter
from convoscope.session import shared_path
from tests.llm.odd import SCHEMA, odd_docs, odd_rows, prose


def top_k(rows, k):
    out = {}
    for i, q in rows:
        if i is None or not q or None in q or i % 10:
            continue
        near = [(-sum(x * y for x, y in zip(q, v, strict=True)), j) for j, v in rows if j is not None and j != i and v and None not in v and len(v) == len(q)]
        out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("block,chunk", [(4096, 4096), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(mtree, "BLOCK_ROWS", block)
    monkeypatch.setattr(mtree, "QUERY_ROWS", chunk)
    rng = random.Random(1)
    rows = [(k, [rng.randint(-300, 300) for _ in range(6)]) for k in range(230)]
    rows += [(300 + k, [5, 5, 5, 5, 5, 5]) for k in range(120)]  # equal vectors tie
    rows += [(None, [1] * 6), (500, None), (501, []), (502, [1, None, 2, 3, 4, 5]), (510, [1, 2, 3]), (520, [0] * 6), (511, [3, 2, 1])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 10 == 0, 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == {i: x for i, x in top_k(rows, 10).items() if x}


@pytest.mark.parametrize("size", [2 * 10**8, 10**9])
def test_top_k_scores_are_exact_at_any_size(spark, size):
    """Products beyond 2**53, where doubles round, and close to 2**63."""
    rng = random.Random(6)
    rows = [(k, [size + rng.randint(-9, 9) for _ in range(8)]) for k in range(60)]
    rows += [(100 + k, [rng.choice([-1, 1]) * (size - k) for _ in range(8)]) for k in range(20)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 10 == 0, 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == top_k(rows, 10)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert mtree.top_k(none, F.col("vec_id") % 10 == 0, 10).collect() == []


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in held)
        level = (total - sum(cap * sizes[s] for s in held)) / rest if rest else 0
        over = {s for s in names if s not in held and level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in held else level * weight[s] for s in names}
        held |= over


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    monkeypatch.setattr(mixing, "BLOCKS_A_GROUP", 2)
    rng = random.Random(3)
    names = ["s0", "s1", "s2", None, "zz", "é"]
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(names[:1] * 6 + names)) for k in range(1500)]
    rows += [(None, "a b", "s1"), (7, None, "s2"), (7, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 120, (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.copies)
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(got, key=key)]


def test_mix_of_a_source_without_ids(spark, monkeypatch):
    """Rows without id are dealt to many blocks, and ties of size and id are drawn alike in every run."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(None, f"w{k} " + "x " * rng.randint(0, 3), "hot") for k in range(3_000)]
    rows += [(7, f"y{k} z", "hot") for k in range(100)] + [(k, "a b c", "other") for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    window = []
    real = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: window.append((name, out := real(df, name))) or out)
    drawn = lambda df: sorted((r.source, r.doc_id or -1, r.text, r.copies) for r in mixing.mix(df).collect())
    first = drawn(docs)
    hot = dict(window)["blocks"].where("source = 'hot'")
    each = dict(window)["targets"].where("_source = 'hot'").first()["_each"]
    assert hot.count() > 50 and hot.selectExpr("max(_sum)").first()[0] <= 200 * each
    assert drawn(docs.repartition(3, "text")) == first and len(first) == len(rows)


def test_mix_of_odd_rows(spark):
    out = mixing.emitted(odd_docs(spark))
    assert out.columns == [*odd_docs(spark).columns, "copy"] and {r["size"] for r in out.collect()} == {"s"}
    mixed = mixing.mix(odd_docs(spark))
    assert mixed.count() == len(odd_rows()) and mixed.where("copies < 0 OR copies > 3").count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = []
    for text, action in url_filter.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, action))
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark):
    urls = """http://WWW.Example.ORG/es/1 http://example.org/es http://example.org/en/12?x=/es/ http://org/ http://xorg/ https://a.com/fr/x
    https://com/de/ http://b.example.com/de/1 http://notexample.org/es/2 http://x.net/?q=://y.org/ ftp://u:p@Example.org:80/es/ nohost http:///p
    http://example.org http://example.org?x http://example.org#f https://best-casino-pills.example.net/en/1 http://thereon.example.net/en/7 éa://ÉX.org/È""".split()
    rows = [(k, u, "h", 1) for k, u in enumerate([*urls, None, "", "a\nb://q.org/x\ny"])]
    model = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, path string, score int"), url_filter.RULES, model)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "score", "verdict"]
    found = {r.page_id: r for r in got.collect()}
    for k, u, *_ in rows:
        host, path = split_url(u)
        rule, action = rule_of(host, path)
        r = found[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.score >= 0.5 else "allow"))
    by_url = {r.url: r for r in found.values()}
    assert by_url["https://best-casino-pills.example.net/en/1"].verdict == "block"
    assert by_url["http://thereon.example.net/en/7"].verdict == "allow"


def test_url_model_on_held_out_rows(spark):
    hold = lambda urls, k: [u for j, u in enumerate(urls) if (j % 4 == 1) == k]
    model = url_filter.train(url_filter.labelled_urls(spark, hold(url_filter.BLOCKED, False), hold(url_filter.ALLOWED, False)))
    test = url_filter.labelled_urls(spark, hold(url_filter.BLOCKED, True), hold(url_filter.ALLOWED, True))
    got = url_filter.judge(test, (), model).collect()
    bad, good = ([r.score for r in got if r.label == y] for y in (1, 0))
    assert sum(x > y for x in bad for y in good) / (len(bad) * len(good)) > 0.6  # area under the curve


def passage_docs():
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 25, 15, 9, 3])] + [(None, prose(rng, 30)), (9, None), (10, "")]
    swap = lambda t, every: " ".join("other" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    rows = [(k, prose(rng, 80)) for k in range(30)]
    rows += [(100, f"{prose(rng, 20)} {items[0][1].upper()}, {prose(rng, 20)}"), (101, swap(items[0][1], 7)), (102, items[1][1])]
    rows += [(103, "x. " + items[2][1] + " y"), (104, items[3][1]), (105, items[4][1]), (106, " ".join(items[0][1].split()[:6]))]
    rows += [(107, None), (108, ""), (None, items[1][1]), (102, items[1][1]), (109, " ".join(items[0][1].split()[10:28]))]
    return items, rows


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_catches_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    items, rows = passage_docs()
    docs = spark.createDataFrame([(*r, "seed", 1) for r in rows], "doc_id long, text string, seed string, place int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert got == {(100, 0), (101, 0), (102, 1), (103, 2), (104, 3), (None, 1), (109, 0)}
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(30), 105, 106, 107, 108], key=str)
    none = spark.createDataFrame([], docs.schema)
    assert decontaminate.overlaps(none, benchmark).collect() == []
    assert decontaminate.overlaps(docs, benchmark.limit(0)).collect() == []


def test_decontamination_finds_two_changed_words_wherever_they_stand(spark):
    """Every pair of places in a 13-word passage from the middle of a long item, at the ends of texts and inside."""
    rng = random.Random(12)
    item = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(13):
        for j in range(i + 1, 13):
            for begin in (0, 20, 60, 137):
                words = item[begin : begin + 13]
                words[i], words[j] = "other", "another"
                before = [f"x{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 250, 300]))]
                rows.append((len(rows), " ".join([*before, *words, *["y"] * rng.choice([0, 5])])))
    clean = [(10_000 + i, " ".join([*item[i : i + 6], *["z"] * 9, *item[i + 30 : i + 37]])) for i in range(100)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, "short words here")], "item_id long, text string")
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(4)
    got = decontaminate.overlaps(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i, _ in rows for k in (1, 2)}
    assert {(r.matched, r.compared) for r in got} == {(11, 13)}


def test_least_hits_equals_enumeration():
    for size in range(4, 14):
        needed = decontaminate.needed_words(size, 80)
        counts = []
        for gone in itertools.combinations(range(size), size - needed):
            same = set(range(size)) - set(gone)
            fits = lambda m, p: all(p + j in same for j, bit in enumerate(m) if bit == "1")
            counts.append(sum(fits(m, p) for m in decontaminate.MASKS for p in range(size - len(m) + 1)))
        assert decontaminate.least_hits(size, needed) == min(counts) >= 1


SECRETS = [
    (1, 'x Password = "abcdefghijkl" y'),
    (2, "token=secret: abcdefghijklmnop"),
    (3, "AKIAABCDEFGHIJ12345 akiaabc AKIA1 0123456789abcdef0"),
    (4, "ſecret=abcdefghijklmnop apI_Key:abcdefghijkl token = 'short'"),
    (5, "é漢 secret=aaaabbbbccccdddd"),
    (6, None),
    (7, ""),
    (8, "é漢 secret=aaaabbbbccccdddd"),
    (None, "passwd: 00112233445566778899"),
    (1, 'x Password = "abcdefghijkl" y'),
    (9, "x " * 30000 + "ghp_" + "a1" * 20),
]


def brute_spans(text):
    text = text or ""
    either = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, secret_ledger.BASE[k]) for a, k, b in sorted(out)]


def test_base_spans_equal_brute_force():
    rng = random.Random(6)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123abcd", "deadbeef", "é", "\n", "passwd", "x.y_z-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [s for s in secret_ledger.find(text) if s[2] in secret_ledger.BASE] == brute_spans(text), text


def test_ledger_scans_each_blob_once(spark, tmp_path):
    path = shared_path(spark, "llm", f"test-{hashlib.md5(str(tmp_path).encode()).hexdigest()}")
    docs = spark.createDataFrame([(*s, "b") for s in SECRETS], "doc_id long, text string, blob string").repartition(3)
    got = secret_ledger.scan(docs, path).collect()
    assert len(got) == len(SECRETS)
    spans = lambda r: [(s.begin, s.end, s.kind) for s in r.found]
    expected = sorted((str(i), [s for s in secret_ledger.find(t or "")]) for i, t in SECRETS)
    assert sorted((str(r.doc_id), spans(r)) for r in got) == expected
    entries = secret_ledger.ledger(spark, path)
    assert entries.count() == len({t or "" for _, t in SECRETS})
    more = docs.unionByName(spark.createDataFrame([(50, "new token=abcdefghijklmnop", "b"), (51, SECRETS[0][1], "b")], docs.schema))
    again = secret_ledger.scan(more, path).collect()
    assert len(again) == len(SECRETS) + 2
    assert secret_ledger.ledger(spark, path).count() == len({t or "" for _, t in SECRETS}) + 1
    assert secret_ledger.ledger(spark, path).groupBy("blob").count().where("count > 1").count() == 0
    hits = secret_ledger.redacted(docs.withColumn("n_chars", F.length("text").cast("long")), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in hits) == sorted(
        (str(i), None if t is None else secret_ledger.masked(t, [s[:2] for s in secret_ledger.find(t)], "[secret]")) for i, t in SECRETS
    )
    assert all(r.n_chars == len(r.text) for r in hits if r.text is not None)
    none = secret_ledger.scan(spark.createDataFrame([], SCHEMA), path + "-none")
    assert none.collect() == []


def test_odd_rows_pass_the_ledger(spark, tmp_path):
    path = shared_path(spark, "llm", f"odd-{hashlib.md5(str(tmp_path).encode()).hexdigest()}")
    assert secret_ledger.scan(odd_docs(spark), path).count() == len(odd_rows())
    assert secret_ledger.redacted(odd_docs(spark), path).columns == odd_docs(spark).columns


@pytest.mark.parametrize("page,fanout", [(4, 2), (16, 8), (512, 8)])
def test_tree_search_equals_brute_force(monkeypatch, page, fanout):
    import numpy as np

    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "FANOUT", fanout)
    rng = np.random.default_rng(page)
    rows = np.vstack([rng.integers(-50, 50, (300, 5)), np.repeat(rng.integers(-50, 50, (3, 5)), 60, axis=0)]).astype(float)
    norms = (rows**2).sum(axis=1)
    tree = mtree.MTree(np.hstack([rows, np.sqrt(norms.max() - norms)[:, None]]))
    ids = rng.permutation(len(rows))
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(len(rows)))
    for q in [*rows[:20], *rng.integers(-50, 50, (20, 5)).astype(float)]:
        own = int(ids[3])
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ q, ids) if i != own)[:10]
        assert sorted((-s, i) for s, i in mtree.search(tree, rows, ids, norms.max(), q, own, 10)) == want


BODY = "\n".join("MIIEpAIBAAKCAQEA" + 48 * c for c in "abXY9+/Q") + "\nq8Zx"


@pytest.mark.parametrize(
    "secret",
    [
        f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}==\n-----END RSA PRIVATE KEY-----",
        f"-----BEGIN ENCRYPTED PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{BODY}\n-----END ENCRYPTED PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY-----\\n" + BODY.replace("\n", "\\n") + "\\n-----END PRIVATE KEY-----",
        f"-----BEGIN PRIVATE KEY-----\n{BODY}",
        f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{BODY}==",
        "-----BEGIN PRIVATE KEY-----",
        "redis://:hunter2xyz@",
        "https://user:" + "p4" * 100 + "@",
        "https://" + "u" * 90 + ":pw@",
    ],
)
def test_whole_secrets_are_masked(secret):
    text = f"before {secret}\nafter it all"
    assert secret_ledger.masked(text, [s[:2] for s in secret_ledger.find(text)], "[secret]") == "before [secret]\nafter it all"


def test_keys_end_where_they_end():
    key = f"-----BEGIN PRIVATE KEY-----\n{BODY}"
    text = f"{key}\nsome words\n{key}\n-----END PRIVATE KEY-----\nmore words"
    assert secret_ledger.masked(text, [s[:2] for s in secret_ledger.find(text)], "*") == "*\nsome words\n*\nmore words"
