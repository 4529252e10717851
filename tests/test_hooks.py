import numpy as np
from pyspark.sql import functions as F

from convoscope.functions.embed import hashing_embedding, model_embedding
from convoscope.operators import features as ft
from convoscope.operators import models as md
from convoscope.operators import sets as so
from convoscope.sources.batches import write_sets_json


def test_tagger_hook_runs_once_per_task(spark):
    toks = spark.createDataFrame([(1, "the"), (1, "bird"), (2, "it")], "doc_id long, token string")

    def load():
        return lambda ts: ["X" + t.upper() for t in ts]

    got = sorted(r["pos"] for r in ft.tag_with_model(toks, load).collect())
    assert got == ["XBIRD", "XIT", "XTHE"]


def test_hashing_embedding_unit_norm(spark):
    df = spark.createDataFrame([(1, "a bird a bird"), (2, "the dancer")], "id long, text string")
    e = hashing_embedding(df, dim=16).collect()
    for r in e:
        assert len(r["embedding"]) == 16 and abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5


def test_model_embedding_hook(spark):
    def make():
        def f(x):
            return np.stack([np.full(4, len(s), dtype=np.float32) for s in x])
        return f

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in model_embedding(df, make, 4).collect()}
    assert got == {1: [3.0] * 4, 2: [0.0] * 4}


def test_fit_or_load_reuses_saved_model(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, LinearRegressionModel

    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, label double")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    path = str(tmp_path / "m")
    m1 = md.fit_or_load(LinearRegression(), data, path, LinearRegressionModel)
    m2 = md.fit_or_load(LinearRegression(maxIter=1), data, path, LinearRegressionModel)
    assert abs(m1.coefficients[0] - 2.0) < 1e-6 and m2.coefficients[0] == m1.coefficients[0]


def test_mirrored_topk_and_json_sink(spark, tmp_path):
    vecs = [np.eye(3)[i % 3] + (0.5 if i == 3 else 0) for i in range(4)]
    rows = [(0, i, "comp", [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(vecs)]
    members = spark.createDataFrame(rows, "set_id long, idx int, set_type string, embedding array<double>")
    top = so.topk_pairs_mirrored(members, n=2).orderBy("rank").collect()
    assert {(top[0]["i"], top[0]["j"]), (top[1]["i"], top[1]["j"])} == {(0, 3), (3, 0)}
    write_sets_json(members.withColumn("image", F.concat(F.col("idx").cast("string"), F.lit(".png"))), str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).collect()
    assert len(back) == 1 and [m["idx"] for m in back[0]["members"]] == [0, 1, 2, 3]


def test_parser_hook_equals_the_expression_path(spark):
    import re

    texts = [(1, "The bird. It sings!\nA the bird"), (2, None), (3, ""), (4, "...no; the END? yes"), (5, "the " * 500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    def load():
        def parse(text):
            found = [s for s in re.split(r"[.!?\n]+\s*", text) if s]
            return [[(t, "DET" if t == "the" else "X") for t in re.findall("[a-z]+", s.lower())] for s in found]

        return parse

    tagged = ft.tag_tokens(ft.token_table(docs), lambda t: F.when(t == "the", "DET").otherwise("X"))
    got = ft.parse_with_model(docs, load)
    assert got.columns == ["doc_id", "sentence_id", "token_id", "token", "pos"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(tagged) and got.count() > 500
