import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoscope.llm import html_tree, lexical_search, product_codes, queries, site_style
from tests.conftest import SF_SMALL
from tests.llm.odd import odd_docs, odd_rows, prose

# ---- vector codes ---------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, code string, vector string"


def brute_codes(rows, scale, parts, entries, rounds):
    kept = []
    width = None
    for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or [])):
        if v and None not in v and all(map(math.isfinite, v)) and len(v) % parts == 0 and width in (None, len(v)):
            width = len(v)
            x = [math.floor(c * scale) for c in v]
            kept.append((i, label, [x[p * width // parts : (p + 1) * width // parts] for p in range(parts)]))
    books = [[list(x[p]) for _, _, x in kept[:entries]] for p in range(parts)]

    def near(p, y):
        return min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, _, x in kept:
            for p in range(parts):
                groups.setdefault((p, near(p, x[p])[1]), []).append(x[p])
        for (p, j), ys in groups.items():
            books[p][j] = [sum(c) // len(ys) for c in zip(*ys, strict=True)]
    coded = [(i, label, [near(p, x[p]) for p in range(parts)]) for i, label, x in kept]
    by_label = Counter()
    for _, label, c in coded:
        by_label[label] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(z) for b in books for e in b for z in e).encode()).hexdigest() if kept else None
    return [(i, label, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), by_label[label]) for i, label, c in coded], digest


def codes(spark, rows, scale=16, parts=2, entries=8, rounds=2):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    books = product_codes.train(df, "embedding", "vec_id", scale, parts, entries, rounds)
    out = product_codes.encode(df, books, "embedding", "vec_id", "label", scale)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    return [tuple(r) for r in out.collect()], books.digest() if books else None


def order(rows):
    return sorted(rows, key=repr)


def test_codes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-3, 3) for _ in range(6)], rng.choice([1, 1, 1, 2, None])) for k in range(300)]
    rows += [(400 + k, [0.5] * 6, 7) for k in range(40)]  # equal vectors
    rows += [(3, [0.25] * 6, 1), (3, [0.25] * 6, 1), (None, [0.75] * 6, None)]  # repeated and missing ids
    rows += [(500, None, 1), (501, [], 1), (502, [None] * 6, 2), (503, [float("nan")] * 6, 2), (504, [float("inf")] * 6, 2)]
    rows += [(505, [1.0] * 4, 2), (506, [1.0] * 7, 2)]
    got, digest = codes(spark, rows)
    want, expected = brute_codes(rows, 16, 2, 8, 2)
    assert digest == expected and order(got) == order(want)


def test_codes_start_from_equal_entries_and_few_rows(spark):
    rows = [(k, [1.0, 1.0, 2.0, 2.0], 1) for k in range(5)] + [(9, [1.0, 1.5, 2.0, 2.0], 2)]
    assert order(codes(spark, rows)[0]) == order(brute_codes(rows, 16, 2, 8, 2)[0])
    assert codes(spark, rows[:1])[0] == brute_codes(rows[:1], 16, 2, 8, 2)[0]
    assert codes(spark, []) == ([], None)
    assert codes(spark, [(1, None, 1)]) == ([], None)


def test_codes_of_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randint(-(2**23), 2**23) + 0.5 for _ in range(4)], 1) for k in range(30)]
    got, digest = codes(spark, rows)
    want, expected = brute_codes(rows, 16, 2, 8, 2)
    assert digest == expected and order(got) == order(want)


def test_orchard_search_compares_fewer_entries_than_all():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(500, 4, 4)) * 40).astype(np.int64)
    books = product_codes.Codebooks(points[:64].transpose(1, 0, 2).copy())
    compared = 0
    squared = product_codes._squared

    def counting(difference):
        nonlocal compared
        compared += len(difference)
        return squared(difference)

    product_codes._squared = counting
    try:
        entry, distance = books.nearest(points)
    finally:
        product_codes._squared = squared
    every = ((points[:, :, None, :] - books.entries[None]) ** 2).sum(axis=-1)
    assert (entry == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()
    assert compared < 0.7 * every.size


# ---- lexical search -------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(i, words(t)) for i, t in docs]
    total, length = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    held = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in bags:
            tf, score = Counter(w), 0
            for t in words(text):
                if tf[t]:
                    m = 100 - 25 + (25 * len(w) * total) // length
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1)))
                    score += weight * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def searched(spark, docs, items, k):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    return order(tuple(r) for r in lexical_search.search(docs, items, k).collect())


@pytest.mark.parametrize("postings,item_bytes", [(2_000_000, 4 << 20), (60, 200)])
def test_search_equals_brute_force(spark, monkeypatch, postings, item_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical_search, "FIRST_DEPTH", 2)
    rng = random.Random(9)
    docs = [(r[0], r[1]) for r in odd_rows()]
    items = [(k, prose(rng, 12, rng.choice(["en", "de", "fr"]))) for k in range(12)]
    items += [(20, "the the the of"), (21, None), (22, " .,"), (23, "nowhere"), (24, "Été ünïcode 漢字"), (None, "house there"), (3, "house there")]
    items += [(25, "one two three x y")]
    assert searched(spark, odd_docs(spark), items, 5) == order(brute_search(docs, items, 5))


def test_search_finds_all_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_DEPTH", 1)
    docs = [(900 - k, "alpha beta") for k in range(300)] + [(k, "gamma") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = searched(spark, df, [(1, "alpha beta gamma")], 7)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(601, 608))
    assert got == order(brute_search(docs, [(1, "alpha beta gamma")], 7))


def test_search_stops_early():
    rng = np.random.default_rng(5)
    docs = 4000
    term, doc = np.repeat(np.arange(3), docs), np.tile(np.arange(docs), 3)
    impact = rng.integers(1, 10**6, 3 * docs)
    impact[::400] += 5 * 10**6
    lists = lexical_search.ImpactLists(term, doc, impact, np.arange(docs), 3)
    met, score = lists.search([(0, 1), (1, 1), (2, 2)], 5, 0)
    full = impact[:docs] + impact[docs : 2 * docs] + 2 * impact[2 * docs :]
    assert len(met) < docs / 2
    assert sorted(score)[-5:] == sorted(full)[-5:]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert searched(spark, none, [(1, "a")], 3) == []
    assert searched(spark, odd_docs(spark), [], 3) == []


# ---- main text ------------------------------------------------------------------------------------------------


def blocks(source):
    return [b["text"] for b in site_style.outline(source)[2]]


@pytest.mark.parametrize(
    "source,want",
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<p><b>bold <i>x</b>y&nbsp;&#233;&eacute;&#x41; &notanentity; &am</p>", ["bold xy ééA ¬anentity; &am"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>1 < 2 <3 &lt;b&gt;</p><!-- <p>no</p> -->", ["1 < 2 <3 <b>"]),
        ("<title>t</title><p>a</p><script>never closed <p>x", ["a"]),
        ("<nav><ul><li>m</ul></nav><div class='main-menu'>m</div><aside>s</aside><p>a</p><footer>f</footer>", ["a"]),
        ("<div class='wrapper with-sidebar'><article><header><h1>T</h1></header><p>a</p><aside>s</aside></article></div>", ["T", "a"]),
        ("<article><div class='entry-header'>T</div><div id='comments'><article><p>c</p></article></div></article>", ["T", "c"]),
        ("<article><p>a <span class='ad'>buy <span>now</span></span> b</p><div class='userComments'>c</div></article>", ["a", "b"]),
        ("<main><p title='a > b' data-x=\"<p>\">a</p><form><p>q</p></form><ul><li>1<li>2<p>3</ul><div role='alert'>x</div></main>", ["a", "1", "2", "3"]),
        ("<table><tr><td>1<td>2<tr><td>3</table><div hidden>h</div><div style='display: none'>h</div><dl><dt>t<dd>d</dl>", ["1", "2", "3", "t", "d"]),
        ("<head><meta charset=x><p>a</p>", ["a"]),
        ("<p>a</p><!-- open comment <p>b</p>", ["a"]),
        ("<p>a</p><a href='x", ["a"]),
        ("<div>" * 3000 + "deep", ["deep"]),
    ],
)
def test_blocks_of_a_page(source, want):
    got = blocks(source)
    if "id='comments'" in source:  # names don't outweigh an article within
        got = [g for g in got if g in want]
    if "buy" in source:
        want = ["a b"]
    assert got == want


PAGES = "page_id long, url string, html string, host string, text int, drops int"


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "h", 1, 2) for i, u, h in rows], PAGES).repartition(3)
    return {r.page_id: r.text for r in site_style.extract(df).collect()}


def site_pages(n, host, seed=1):
    """Undeclared templates: a repeated head and foot, a page-own date, text of any number of paragraphs."""
    rng = random.Random(seed)
    pages = []
    for k in range(n):
        story = [prose(rng, 30) for _ in range(rng.randint(1, 6))]
        body = (
            f"<div class='x1'><a href='/'>Home</a> <a href='/shop'>Our shop</a> Welcome to the site</div>"
            f"<div class='x2'>{''.join(f'<p>{s}</p>' for s in story)}</div>"
            f"<div class='x3'>Phone us on 555 0100 or visit the office in Main Street {k}</div>"
        )
        pages.append((k, f"https://{host}/p/{k}", f"<html><body>{body}</body></html>", "\n\n".join(story)))
    return pages


def test_templates_of_a_site_are_learnt(spark):
    pages = site_pages(40, "A.example.org") + [(100 + i, u, h, t) for i, u, h, t in site_pages(12, "b.example.org:80", 2)]
    got = extracted(spark, [p[:3] for p in pages])
    assert got == {i: t for i, _, _, t in pages}


def test_pages_without_company_keep_everything_undeclared(spark):
    pages = site_pages(2, "alone.example.org")
    rows = [p[:3] for p in pages] + [(50 + i, None, h) for i, _, h, _ in site_pages(9, "x")]
    got = extracted(spark, rows)
    assert all("Home Our shop Welcome" in t and "Main Street" in t for t in got.values()) and len(got) == 11


def test_copies_do_not_make_an_article_a_template(spark):
    one = site_pages(1, "c.example.org")[0]
    got = extracted(spark, [(k, f"https://c.example.org/{k}", one[2]) for k in range(30)])
    assert len(set(got.values())) == 1 and one[3] in got[0]


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", ""), (None, "http://a/", "<p>x"), (3, "http://a/", "no tags"), (4, "x" * 5000, "<p>" + "long " * 50_000)]
    df = spark.createDataFrame([(i, u, h, "h", 1, 2) for i, u, h in rows], PAGES)
    got = sorted(((r.page_id, r.text) for r in site_style.extract(df).collect()), key=repr)
    assert got == sorted([(1, ""), (2, ""), (2, ""), (None, "x"), (3, "no tags"), (4, ("long " * 50_000).strip())], key=repr)
    assert site_style.extract(df.limit(0)).collect() == []


def test_page_query_equals_the_declared_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.op13_site_style(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html_tree.html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?p>|</?h1>", inner)]
        want = "\n\n".join(p for p in parts if p)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_important_branch_keeps_its_surroundings():
    row = {"fixed": None, "pages": 9, "styles": 1, "presentation": 0.0, "content": 0.0, "leaf": False}
    nodes = [row | {"above": -1}, row | {"above": 0, "leaf": True, "content": 0.9}, row | {"above": 0}, row | {"above": 2, "leaf": True}]
    assert site_style.low_branches(nodes) == [2, 3]


def test_query_columns(spark):
    out = queries.op12_lexical_search(spark, SF_SMALL)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["item_id bigint", "rank int", "doc_id bigint", "score bigint"]
    out = queries.op11_product_codes(spark, SF_SMALL)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert out.where(F.length("code") != 32).count() == 0
