import numpy as np

from convoscope.operators import vectors as vx
from convoscope.plans import fixtures as fx
from convoscope.sources.tables import table
from tests.conftest import SF_SMALL


def _sequential(X, A, keep):
    """Plain step-by-step residual updates."""
    r = X.copy()
    projs, ves = [], []
    total = X.var(axis=0).sum()
    for a, k in zip(A, keep):
        p = r @ a
        projs.append(p)
        ves.append(p.var() / total)
        if k:
            r = r - np.outer(p, a)
    return r, projs, ves


def test_one_pass_reduction_equals_sequential(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    anchors = fx.anchors_f(spark)
    plan = vx.plan_anchors(vx.anchor_vectors(emb, anchors), anchors)
    pdf = emb.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    X = np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=float)))
    r, projs, ves = _sequential(X, plan.anchors, plan.keep)
    res = vx.anchor_residuals(emb, plan).toPandas().sort_values("vec_id")
    R = np.stack(res.residual.map(np.asarray))
    assert np.abs(R - r).max() < 1e-9
    last = [i for i, k in enumerate(plan.keep) if k][-1]
    assert np.abs(R @ plan.anchors[last]).max() < 1e-6  # deflated residual is orthogonal to the last anchor
    var = vx.anchor_variance(emb, plan).toPandas().sort_values("step")
    assert np.allclose(var.variance_explained.to_numpy(), np.round(ves, 6), atol=1e-6)
    assert np.allclose(var.cumulative_variance.to_numpy(), np.round(np.cumsum(ves), 6), atol=1e-6)


def test_pca_sign_is_canonical(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    _m, fixed, explained = vx.pca(emb, 3)
    idx = np.abs(fixed).argmax(axis=0)
    assert (fixed[idx, range(3)] > 0).all()
    assert (np.diff(explained) <= 1e-12).all()


def _matrix(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    pdf = emb.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    return emb, np.stack(pdf.embedding.map(lambda v: np.asarray(v, dtype=float))), pdf.vec_id.to_numpy()


def _components(x, k):
    values, axes = np.linalg.eigh(np.cov(x.T))
    top = np.argsort(-values)[:k]
    pcs = axes[:, top].T
    return values[top] / values.sum(), pcs * np.sign(pcs[np.arange(k), np.abs(pcs).argmax(axis=1)])[:, None]


def test_components_scores_and_extremes_match_numpy(spark):
    from __spark_entry__ import queries

    emb, x, ids = _matrix(spark)
    share, pcs = _components(x, 5)
    fit = queries()["pca_fit"](spark, SF_SMALL).toPandas().pivot(index="pc", columns="dim", values="loading").to_numpy()
    assert np.allclose(fit, pcs, atol=1e-4)
    got = queries()["pca_scores"](spark, SF_SMALL).toPandas().sort_values("vec_id").iloc[:, 1:].to_numpy()
    assert np.allclose(got, x @ pcs.T, atol=1e-4)
    ext = queries()["pc_extremes"](spark, SF_SMALL).toPandas()
    assert set(ext.groupby(["pc", "end"]).size()) == {10}
    for (_, end), part in ext.sort_values("rank").groupby(["pc", "end"]):
        s = part.score.to_numpy()
        assert (np.diff(s) <= 0).all() if end == "top" else (np.diff(s) >= 0).all()


def test_residual_components_match_deflated_data(spark):
    emb, x, _ = _matrix(spark)
    anchors = fx.anchors_f(spark)
    plan = vx.plan_anchors(vx.anchor_vectors(emb, anchors), anchors)
    r, total = x.copy(), np.trace(np.cov(x.T))
    for (share, pcs, raw), a, keep in zip(vx.residual_components(emb, plan, 3), plan.anchors, plan.keep, strict=True):
        values, axes = np.linalg.eigh(np.cov(r.T))
        top = np.argsort(-values)[:3]
        assert np.allclose(share, values[top] / total, atol=1e-6)
        assert np.allclose(np.abs((pcs * axes[:, top].T).sum(axis=1)), 1, atol=1e-4)
        assert np.allclose(x @ raw.T, r @ pcs.T, atol=1e-6)
        if keep:
            r = r - np.outer(r @ a, a)


def test_wide_dims_and_anchor_words(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 3.0)], "id int, dim_10 double, dim_2 double, dim_0 double")
    assert vx.dims_to_vector(df).first().embedding == [3.0, 2.0, 0.5]
    rows = vx.anchor_words(spark.createDataFrame([(1, " big , small,tiny ")], "step int, words string")).collect()
    assert [(r.step, r.position, r.word, r.name) for r in rows] == [(1, 1, "big", "big"), (1, 2, "small", "big"), (1, 3, "tiny", "big")]


def test_top_similar_equals_brute_force(spark, monkeypatch):
    from convoscope.operators import vectors as vx

    monkeypatch.setattr(vx, "BLOCK_ROWS", 30)  # several blocks on both sides
    rng = np.random.default_rng(7)
    left = [(int(k), [float(x) for x in rng.integers(-3, 4, 5)]) for k in range(70)]
    right = [(int(k), [float(x) for x in rng.integers(-3, 4, 5)]) for k in range(95)]
    odd = [(None, [1.0] * 5), (500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [1.0, 2.0])]
    schema = "id long, embedding array<double>, rank int, col int"
    frame = lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], schema).repartition(3)
    out = vx.top_similar(frame(left + odd).withColumnRenamed("id", "a"), frame(right + odd[:4]).withColumnRenamed("id", "b"), 4, "a", "b")
    assert out.columns == ["a", "rank", "b", "similarity"]
    got = sorted((r.a, r["rank"], r.b, r.similarity) for r in out.collect())
    want = []
    for i, x in left:
        near = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for j, y in right)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert got == sorted(want)
    assert vx.top_similar(frame([]).withColumnRenamed("id", "a"), frame(right).withColumnRenamed("id", "b"), 4, "a", "b").collect() == []
