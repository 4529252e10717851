"""The pipeline and its stages against a brute-force version on planted rows."""

import random
import re

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from convoscope.llm import queries as llm
from convoscope.llm import secret_ledger
from tests.llm.odd import prose
from tests.llm.test_dedup import brute_groups
from tests.llm.test_selection import targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, copies int"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, prose(rng, 30)) for k in range(4)]
    rows, toxic, leaked = [], set(), set()
    for k in range(400):
        words = prose(rng, rng.randint(40, 90)).split()
        if k % 8 == 0:
            toxic.add(k)
            words.insert(rng.randrange(len(words)), rng.choice(["zorblat", "quixem"]) + rng.choice(["", "ed"]))
            words.insert(rng.randrange(len(words)), "vrunto")
        elif k % 37 == 1:
            leaked.add(k)
            words[10:10] = items[k % 4][1].split()
        elif k % 11 == 2:
            words.insert(5, f"token={rng.getrandbits(80):020x}")
        rows.append((k, " ".join(words)))
    clean = [(k, t) for k, t in rows if k not in toxic and k not in leaked]
    rows += [(1000 + n, t) for n, (_, t) in enumerate(clean[:30])]  # exact copies
    for n, (_, t) in enumerate(clean[30:60]):  # near copies
        rows.append((2000 + n, t + " changed"))
    rows += [(3000, None), (3001, ""), (None, clean[70][1]), (None, prose(rng, 50))]
    rng.shuffle(rows)
    docs = [(i, t, "en", [None, "a", "b"][k % 3], len(t or ""), 1, 9) for k, (i, t) in enumerate(rows)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i, _ in rows if i is not None and i < 1000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, toxic, leaked


def test_stages_take_effect(spark, planted):
    path, docs, toxic, leaked = planted
    rows = [(d[0], d[1]) for d in docs]
    expected = [r for r in rows if r[0] not in toxic]
    df = spark.read.parquet(f"{path}/documents.parquet")
    columns = df.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, path)
        target = f"{path}/out-{name}"
        df.write.parquet(target)
        df = spark.read.parquet(target)
        out[name] = df.collect()
        if name != "mix":
            assert df.columns == columns
    pairs = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found)
    want = lambda found: sorted((i is None, i or 0, t or "") for i, t in found)
    assert pairs(out["toxicity"]) == want(expected)
    groups = brute_groups(expected, 80)
    texts = {t for i, t in expected if i is not None}
    expected = [(i, t) for i, t in expected if (groups.get(i, i) == i if i is not None else t not in texts)]
    assert pairs(out["near_duplicates"]) == want(expected)
    expected = [r for r in expected if r[0] not in leaked]
    assert pairs(out["decontamination"]) == want(expected)
    expected = [(i, t and secret_ledger.masked(t, [s[:2] for s in secret_ledger.find(t)], "[secret]")) for i, t in expected]
    assert any("[secret]" in (t or "") for _, t in expected)
    assert pairs(out["secrets"]) == want(expected)
    assert all(r.n_chars == len(r.text or "") for r in out["secrets"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, copies = {}, {}, {}
    for r in out["secrets"]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in out["mix"]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        copies[r.doc_id, r.text] = max(copies.get((r.doc_id, r.text), 0), r.copy)
    known = {(r.doc_id, r.text) for r in out["secrets"]}
    assert set(copies) <= known and max(copies.values()) <= 3
    for s, n in targets(sizes).items():
        assert abs(taken.get(s, 0) - n) <= 250


def test_run_equals_the_stages(spark, planted):
    path, *_ = planted
    once = corpus_pipeline.run(spark, path).collect()
    again = queries()["pipeline"](spark, path).collect()
    key = lambda r: str((r.doc_id, r.text, r.copy))
    assert once and sorted(map(key, once)) == sorted(map(key, again))


def test_repeated_ids_and_blank_rows(spark, planted):
    """Rows of one id are judged by their own texts; blank rows are linked with nothing."""
    path, *_ = planted
    rng = random.Random(31)
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, a + " x"), (None, c), (None, c), (None, None), (None, " "), (None, " "), (4, ""), (4, None)]
    rows += [(7, item), (7, b + " " + prose(rng, 80)), (None, item), (8, c[:-4])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, 9) for i, t in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, path).collect()]
    blank = [(i, t) for i, t in rows if not (t or "").strip()]
    assert sorted(map(str, kept)) == sorted(map(str, [(2, a + " x"), (1, b), (8, c[:-4]), rows[12], (7, item), *blank]))
    clean = [(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, path).collect()]
    assert sorted(map(str, clean)) == sorted(map(str, [r for r in rows if r[1] != item]))


def test_empty_tables(spark, planted, tmp_path):
    path, *_ = planted
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered_queries():
    names = sorted(llm.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(llm.QUERIES) | {"pipeline"} <= set(queries())
    assert set(llm.ORACLE_SQL) <= set(oracle_sql()) and "pipeline" not in oracle_sql()
