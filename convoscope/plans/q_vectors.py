"""Embedding query keys (long form, variance, anchors, deflation, PCA)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convoscope.functions.vectors import normalize
from convoscope.operators import vectors as vx
from convoscope.plans import fixtures as fx
from convoscope.plans.q_features import describers_from_docs, messages_of_docs
from convoscope.plans.registry import register
from convoscope.session import shared_path
from convoscope.sources.csv import read_csv_dir, write_csv
from convoscope.sources.tables import table

PCA_K = 5

_LONG = """ long AS (SELECT vec_id, label, CAST(d AS INTEGER) AS dim, CAST(v AS DOUBLE) AS value
   FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, unnest(embedding) AS v FROM embeddings)),
 al AS (SELECT a.step, a.name, l.dim, avg(l.value) AS mean FROM anchors_f a JOIN long l ON a.label = l.label GROUP BY a.step, a.name, l.dim),
 av AS (SELECT step, name, dim, mean / sqrt(sum(mean * mean) OVER (PARTITION BY step)) AS value FROM al),
 am AS (SELECT step, list(value ORDER BY dim) AS a FROM av GROUP BY step),
 tv AS (SELECT sum(v) AS total_variance FROM (SELECT dim, var_pop(value) AS v FROM long GROUP BY dim))
"""


def _steps():
    seen = {}
    for step, name, _label, keep in fx.ANCHOR_ROWS:
        seen[step] = (name, keep)
    return sorted((s, n, k) for s, (n, k) in seen.items())


def _chain_sql() -> str:
    """Residuals updated step by step, the plain way: p_s = r.a_s, and kept
    steps deflate r -= p_s a_s."""
    parts = [" r0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings)"]
    prev = "r0"
    for i, (s, _n, keep) in enumerate(_steps(), 1):
        parts.append(
            f" p{i} AS (SELECT x.*, list_dot_product(x.r, m.a) AS p_{s}, m.a AS a_{s} FROM {prev} x JOIN (SELECT a FROM am WHERE step = {s}) m ON true)"
        )
        if keep:
            parts.append(
                f" r{i} AS (SELECT * EXCLUDE (r, a_{s}), list_transform(range(1, len(r) + 1), lambda j: r[j] - p_{s} * a_{s}[j]) AS r FROM p{i})"
            )
        else:
            parts.append(f" r{i} AS (SELECT * EXCLUDE (a_{s}) FROM p{i})")
        prev = f"r{i}"
    parts.append(f" fin AS (SELECT * FROM {prev})")
    return ",\n".join(parts) + "\n"


def _sql(body: str) -> str:
    return fx.with_views("", "anchors_f").rstrip() + ",\n" + _LONG + "," + _chain_sql() + body


def _plan(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    anchors = fx.anchors_f(spark)
    return emb, vx.plan_anchors(vx.anchor_vectors(emb, anchors), anchors)


@register("emb_to_long", _sql("SELECT vec_id, dim, round(value, 6) AS value FROM long"))
def q_emb_to_long(spark, sf_dir):
    return vx.emb_long(table(spark, sf_dir, "embeddings")).withColumn("value", F.round("value", 6))


@register(
    "emb_normalize",
    _sql(
        """SELECT vec_id, CAST(d AS INTEGER) AS dim, round(v / nrm, 6) AS value FROM (SELECT vec_id, unnest(range(0, len(e))) AS d, unnest(e) AS v,
  sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
    ),
)
def q_emb_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", normalize("embedding").alias("embedding"))
    return vx.emb_long(e).withColumn("value", F.round("value", 6))


@register("total_variance", _sql("SELECT round(total_variance, 6) AS total_variance FROM tv"))
def q_total_variance(spark, sf_dir):
    return vx.total_variance(table(spark, sf_dir, "embeddings")).select(F.round("total_variance", 6).alias("total_variance"))


@register("anchor_vectors", _sql("SELECT step, name, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM av"))
def q_anchor_vectors(spark, sf_dir):
    v = vx.anchor_vectors(table(spark, sf_dir, "embeddings"), fx.anchors_f(spark))
    return v.withColumn("value", F.round("value", 6))


def _variance_sql() -> str:
    sel = []
    for s, n, k in _steps():
        sel.append(
            f"SELECT {s} AS step, '{n}' AS name, {'true' if k else 'false'} AS keep, (SELECT var_pop(p_{s}) FROM fin) / (SELECT total_variance FROM tv) AS ve"
        )
    return (
        "SELECT CAST(step AS INTEGER) AS step, name, keep, round(ve, 6) AS variance_explained, "
        "round(sum(ve) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative_variance FROM ("
        + " UNION ALL ".join(sel)
        + ")"
    )


@register("anchor_variance", _sql(_variance_sql()))
def q_anchor_variance(spark, sf_dir):
    emb, plan = _plan(spark, sf_dir)
    return vx.anchor_variance(emb, plan)


def _project_sql() -> str:
    cols = ", ".join(f"round(p_{s}, 6) AS {n}" for s, n, k in _steps() if k)
    return f"SELECT vec_id, {cols} FROM fin"


@register("anchor_project", _sql(_project_sql()))
def q_anchor_project(spark, sf_dir):
    emb, plan = _plan(spark, sf_dir)
    return vx.anchor_project(emb, plan)


@register(
    "anchor_deflate",
    _sql(
        "SELECT vec_id, CAST(d AS INTEGER) AS dim, round(v, 6) AS value FROM (SELECT vec_id, unnest(range(0, len(r))) AS d, unnest(r) AS v FROM fin)"
    ),
)
def q_anchor_deflate(spark, sf_dir):
    emb, plan = _plan(spark, sf_dir)
    res = vx.anchor_residuals(emb, plan)
    long = res.select("vec_id", F.posexplode("residual").alias("dim", "value"))
    return long.select("vec_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@register(
    "cross_similarity",
    _sql(
        "SELECT e.vec_id, CAST(m.step AS INTEGER) AS step, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), m.a), 6) AS similarity FROM embeddings e JOIN am m ON true"
    ),
)
def q_cross_similarity(spark, sf_dir):
    emb, plan = _plan(spark, sf_dir)
    return vx.similarity_to_anchors(emb, plan)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
TOP_PAGES = 5


def letter_vectors(df, text: str):
    """A unit vector of letter counts: a stand-in for an encoder that runs in Spark and in SQL alike."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = F.array(*[(F.length("_low") - F.length(F.replace(F.col("_low"), F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    # an exploded array of one keeps the counts from being put into every use of them
    counts = df.select("*", F.explode(F.array(low)).alias("_low")).select("*", F.explode(F.array(counts)).alias("_n")).drop("_low")
    size = F.sqrt(F.aggregate("_n", F.lit(0.0), lambda s, x: s + x * x))
    sized = counts.select("*", F.explode(F.array(size)).alias("_size")).where("_size > 0")
    return sized.withColumn("embedding", F.transform("_n", lambda x: x / F.col("_size"))).drop("_n", "_size")


def _letters_sql(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    counts = ", ".join(f"CAST(length({low}) - length(replace({low}, '{c}', '')) AS DOUBLE)" for c in LETTERS)
    return f"[{counts}]"


@register(
    "text_image_similarity",
    f"""WITH t AS (SELECT item_id, {_letters_sql('text')} AS n FROM benchmark),
 p AS (SELECT page_id, {_letters_sql('html')} AS n FROM pages),
 tu AS (SELECT item_id, n, sqrt(list_dot_product(n, n)) AS s FROM t WHERE list_sum(n) > 0),
 pu AS (SELECT page_id, n, sqrt(list_dot_product(n, n)) AS s FROM p WHERE list_sum(n) > 0),
 x AS (SELECT item_id, page_id, round(list_dot_product(tu.n, pu.n) / (tu.s * pu.s), 9) AS c FROM tu, pu)
SELECT item_id, CAST(rank AS INTEGER) AS rank, page_id, round(c, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, page_id) AS rank FROM x) WHERE rank <= {TOP_PAGES}""",
)
def q_text_image_similarity(spark, sf_dir):
    """Every benchmark text against every page: the pages nearest to each text."""
    texts = letter_vectors(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    pages = letter_vectors(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return vx.top_similar(texts, pages, TOP_PAGES, "item_id", "page_id")


def _pca(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    _model, fixed, explained = vx.pca(emb, PCA_K)
    return emb, fixed, explained


@register("pca_fit")
def q_pca_fit(spark, sf_dir):
    _emb, fixed, explained = _pca(spark, sf_dir)
    return vx.pca_loadings(spark, fixed, explained)


@register("pca_scores")
def q_pca_scores(spark, sf_dir):
    emb, fixed, _ = _pca(spark, sf_dir)
    return vx.pca_scores(emb, fixed)


@register("pc_extremes")
def q_pc_extremes(spark, sf_dir):
    """Scores joined to the describer texts (vec_id = doc_id), then the ten
    highest and lowest rows per component."""
    emb, fixed, _ = _pca(spark, sf_dir)
    texts = describers_from_docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    scores = vx.pca_scores(emb, fixed).join(texts, "vec_id", "inner")
    return vx.pc_extremes(scores, PCA_K).select("pc", "end", "rank", "vec_id", "score", "text")


@register("residual_components")
def q_residual_components(spark, sf_dir):
    """Leading components of the residuals before each step."""
    emb, plan = _plan(spark, sf_dir)
    rows = [
        (s, j + 1, i, float(round(pcs[j, i], 6)), float(round(share[j], 6)))
        for s, (share, pcs, _) in zip(plan.steps, vx.residual_components(emb, plan, PCA_K), strict=True)
        for j in range(len(pcs))
        for i in range(pcs.shape[1])
    ]
    return spark.createDataFrame(rows, "step int, pc int, dim int, loading double, variance_share double")


@register("residual_extremes")
def q_residual_extremes(spark, sf_dir):
    emb, plan = _plan(spark, sf_dir)
    texts = messages_of_docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    return vx.residual_extremes(emb, texts, vx.residual_components(emb, plan, PCA_K), plan.steps)


def _dimension_text_sql() -> str:
    cols = ", ".join(f"round(p_{s}, 6) AS {n}" for s, n, k in _steps() if k)
    return f"SELECT fin.vec_id, {cols}, d.text FROM fin JOIN docs_f d ON d.doc_id = fin.vec_id WHERE d.role = 'describer'"


@register(
    "dimension_table",
    fx.with_views("", "anchors_f", "docs_f").rstrip() + ",\n" + _LONG + "," + _chain_sql() + _dimension_text_sql(),
)
def q_dimension_table(spark, sf_dir):
    """Accepted dimensions joined to the texts, written as CSV and read back."""
    emb, plan = _plan(spark, sf_dir)
    texts = messages_of_docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    out = vx.anchor_project(emb, plan).join(texts, "vec_id")
    root = shared_path(spark, "dimensions", uuid.uuid4().hex)
    write_csv(out, root)
    return read_csv_dir(spark, root, out.schema)
