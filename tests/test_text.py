import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoscope.functions.text import (
    clean_text,
    fuzzy_contains,
    phrase_count,
    sentences,
    tokens,
    with_first_token,
    word_count,
)
from tests.approx import fuzzy_contains_reference


def test_clean_text_goldens(spark):
    df = spark.createDataFrame([("Don't\nGO  left-ish!",), ("123",), (None,)], "t string")
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert got == ["dontgo leftish", "", None]


def test_fuzzy_goldens(spark):
    cases = [
        ("dancer", "the dansr man", False),
        ("dancer", "the dancr man", True),
        ("a", "", True),
        ("abcdefghijk", "xabcdefgijkx", True),
    ]
    df = spark.createDataFrame(cases, "p string, t string, e boolean")
    out = df.select("e", fuzzy_contains(F.col("p"), F.col("t")).alias("g")).collect()
    assert all(r["e"] == r["g"] for r in out)


def test_fuzzy_matches_dynamic_programming(spark):
    random.seed(7)
    rows = []
    for _ in range(600):
        p = "".join(random.choice("ab ") for _ in range(random.randint(1, 22))).strip() or "a"
        t = "".join(random.choice("ab ") for _ in range(random.randint(0, 35)))
        rows.append((p, t, fuzzy_contains_reference(p, t)))
    df = spark.createDataFrame(rows, "p string, t string, e boolean")
    bad = df.where(fuzzy_contains(F.col("p"), F.col("t")) != F.col("e")).count()
    assert bad == 0


def test_fuzzy_contains_of_any_length(spark):
    """Patterns of 1 to 300 characters, near and far, at both ends of the text, with signs of regular expressions."""
    rng = random.Random(7)
    rows = []
    for m in [*range(1, 31), 45, 64, 90, 101, 150, 199, 230, 300]:
        for _ in range(6):
            letters = rng.choice(["ab", "abcdefghij ", "a.*([\\\\$é漢"])
            p = "".join(rng.choice(letters) for _ in range(m))
            q = list(p)
            for _ in range(rng.randint(0, 4 * (m // 10) + 6)):
                at = rng.randrange(len(q) + 1)
                q[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "b"])
            pad = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 3, 40])))
            t = pad() + "".join(q) + pad()
            rows.append((p, t, fuzzy_contains_reference(p, t)))
    assert 40 < sum(r[2] for r in rows) < len(rows) - 40
    df = spark.createDataFrame(rows, "p string, t string, e boolean").repartition(8)
    assert [(r.p, r.t) for r in df.where(fuzzy_contains(F.col("p"), F.col("t")) != F.col("e")).collect()] == []


def test_fuzzy_contains_of_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("", None), ("abc", None), ("a", "")], "p string, t string")
    assert [r[0] for r in df.select(fuzzy_contains("p", "t")).collect()] == [None, True, False, True]


def test_phrase_count_no_word_boundaries(spark):
    df = spark.createDataFrame([("It is Unlikely, likely maybe MAYBE",), (None,)], "t string")
    got = [r[0] for r in df.select(phrase_count("t", ["likely", "maybe"])).collect()]
    assert got == [4, 0]


def test_word_count_single_space_split(spark):
    df = spark.createDataFrame([("a  b ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [4, 1, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n\t", max_size=30))
def test_first_token_equals_first_sentence_token(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    df = with_first_token(df, "text", "ft")
    viaspl = F.regexp_extract(F.lower(F.try_element_at(sentences("text"), F.lit(1))), "[a-z]+", 0)
    r = df.select("ft", F.when(viaspl != "", viaspl).alias("ref")).collect()[0]
    assert r["ft"] == r["ref"]


def test_tokens_lower_alpha(spark):
    df = spark.createDataFrame([("He's 2 Big-dogs!",)], "t string")
    assert df.select(tokens("t")).collect()[0][0] == ["he", "s", "big", "dogs"]


def test_markup_rewrite_changes_the_pages(spark):
    from convoscope.operators import chat
    from convoscope.plans.q_text import MARKUP_PREFIX, MARKUP_REPLACEMENTS, PAGE_REPLACEMENTS
    from convoscope.sources.tables import table
    from tests.conftest import SF_SMALL

    pages = table(spark, SF_SMALL, "pages")
    out = chat.markup_rewrite(pages, MARKUP_REPLACEMENTS + PAGE_REPLACEMENTS, prefix=MARKUP_PREFIX)
    before = {r.page_id: r.html for r in pages.collect()}
    changed = [r.html != before[r.page_id].replace("\n", " ") for r in out.collect()]
    assert changed and all(changed)
    svg = spark.createDataFrame([(1, "https://x", '<path fill="lightgray" stroke="white" strokewidth="1"/>\n')], "page_id int, url string, html string")
    assert chat.markup_rewrite(svg, MARKUP_REPLACEMENTS, prefix=MARKUP_PREFIX).first().html == '<path fill="black" stroke="black" strokewidth="2"/> '
