"""Embedding work: long form, variance, anchored projections with deflation,
rectangular similarity, PCA.

Anchored reduction.  Each step s has an anchor a_s (unit mean of the vectors
of its labels) and a keep flag.  On residuals r_{s-1} the projection is
p_s = r_{s-1}.a_s; kept steps deflate r_s = r_{s-1} - p_s a_s.  Because every
r is a linear map of the input x, p_s = x.b_s with
b_s = a_s - sum_{kept t<s} (a_t.a_s) b_t, computed on the driver from the k x d
anchor matrix (a parameter-sized aggregate).  So all projections, all step
variances and the final residual come from single passes over the vectors --
no per-step lineage, no loop over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from convoscope.functions.vectors import dot_literal
from convoscope.operators.joins import attach_row, broadcast_if_small

MAX_ANCHOR_ROWS = 100_000  # steps x dims collected to the driver


def emb_long(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    x = df.select(key, F.posexplode(vec).alias("dim", "value"))
    return x.select(key, x["dim"].cast("int").alias("dim"), x["value"].cast("double").alias("value"))


def total_variance(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Sum over dimensions of the population variance.  The long form is
    aggregated per dimension with map-side partial aggregation: the shuffle
    carries d rows per task."""
    long = emb_long(df, vec=vec)
    per_dim = long.groupBy("dim").agg(F.var_pop("value").alias("v"))
    return per_dim.agg(F.sum("v").alias("total_variance"))


def anchor_vectors(emb: DataFrame, anchors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per step: mean of the member vectors, divided by its norm; long form
    (step, name, dim, value).  The anchor definition table is a parameter
    (steps x labels), broadcast behind a size check."""
    a = broadcast_if_small(anchors.select("step", "name", label), MAX_ANCHOR_ROWS)
    m = emb.select(label, F.posexplode(vec).alias("dim", "value")).join(a, label)
    mean = m.groupBy("step", "name", "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    w = Window.partitionBy("step")
    n = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(w))
    return mean.select("step", "name", F.col("dim").cast("int").alias("dim"), (F.col("mean") / n).alias("value"))


@dataclass
class AnchorPlan:
    steps: list[int]
    names: list[str]
    keep: list[bool]
    anchors: np.ndarray  # k x d
    b: np.ndarray  # k x d: p_s = x . b_s


def plan_anchors(anchor_long: DataFrame, anchors: DataFrame) -> AnchorPlan:
    """Collect the (bounded) anchor matrix and derive the projection vectors."""
    meta = anchors.select("step", "name", "keep").distinct().orderBy("step").collect()
    rows = anchor_long.select("step", "dim", "value").limit(MAX_ANCHOR_ROWS + 1).collect()
    if len(rows) > MAX_ANCHOR_ROWS:
        raise ValueError(f"anchor matrix too large to plan on the driver: over {MAX_ANCHOR_ROWS} values")
    steps = [r["step"] for r in meta]
    d = 1 + max(r["dim"] for r in rows)
    idx = {s: i for i, s in enumerate(steps)}
    A = np.zeros((len(steps), d))
    for r in rows:
        A[idx[r["step"]], r["dim"]] = r["value"]
    keep = [bool(r["keep"]) for r in meta]
    B = np.zeros_like(A)
    for s in range(len(steps)):
        b = A[s].copy()
        for t in range(s):
            if keep[t]:
                b -= float(A[t] @ A[s]) * B[t]
        B[s] = b
    return AnchorPlan(steps, [r["name"] for r in meta], keep, A, B)


def anchor_projections(emb: DataFrame, plan: AnchorPlan, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One column ``p_<step>`` per step: the projection of that step's residual."""
    cols = [dot_literal(vec, plan.b[i]).alias(f"p_{s}") for i, s in enumerate(plan.steps)]
    return emb.select(key, vec, *cols)


def anchor_variance(emb: DataFrame, plan: AnchorPlan, vec: str = "embedding") -> DataFrame:
    """Per step: variance of its projection over the total variance, and the
    running total in step order (rejected steps count too)."""
    proj = anchor_projections(emb, plan, vec=vec)
    total = total_variance(emb, vec=vec)
    vars_ = proj.agg(*[F.var_pop(f"p_{s}").alias(f"v_{s}") for s in plan.steps])
    meta = emb.sparkSession.createDataFrame(
        list(zip(plan.steps, plan.names, plan.keep)), "step int, name string, keep boolean"
    )
    long = vars_.unpivot([], [f"v_{s}" for s in plan.steps], "col", "var").select(
        F.regexp_extract("col", r"v_(\d+)", 1).cast("int").alias("step"), "var"
    )
    # the one-row total is attached as a scalar subquery; the k-row step
    # table (a parameter) is broadcast
    j = attach_row(long, total).join(F.broadcast(meta), "step")
    ve = F.col("var") / F.col("total_variance")
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        "step", "name", "keep",
        F.round(ve, 6).alias("variance_explained"),
        F.round(F.sum(ve).over(w), 6).alias("cumulative_variance"),
    )


def anchor_project(emb: DataFrame, plan: AnchorPlan, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Keys plus one column per accepted step, named after the step."""
    proj = anchor_projections(emb, plan, key=key, vec=vec)
    cols = [F.round(f"p_{s}", 6).alias(nm) for s, nm, k in zip(plan.steps, plan.names, plan.keep) if k]
    return proj.select(key, *cols)


def anchor_residuals(emb: DataFrame, plan: AnchorPlan, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Vectors after deflating every accepted step: R = X - (X B_k^T) A_k.

    Dense linear algebra on a batch of vectors: an Arrow-batched pandas UDF
    does one matrix product per batch (the k x d constants travel with the
    function).  Spark still partitions the rows; nothing is collected."""
    kept = [i for i, k in enumerate(plan.keep) if k]
    a_k = plan.anchors[kept]
    b_k = plan.b[kept]

    @pandas_udf("array<double>")
    def deflate(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(e, dtype=np.float64) for e in v])
        r = x - (x @ b_k.T) @ a_k if kept else x
        return pd.Series(list(r))

    return emb.select(key, deflate(F.col(vec)).alias("residual"))


def similarity_to_anchors(emb: DataFrame, plan: AnchorPlan, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Rectangular similarity (vectors x anchors) as k dot-product columns,
    unpivoted: no join, the anchor side is a driver-side parameter."""
    cols = [dot_literal(vec, plan.anchors[i]).alias(f"s_{s}") for i, s in enumerate(plan.steps)]
    wide = emb.select(key, *cols)
    long = wide.unpivot([key], [f"s_{s}" for s in plan.steps], "col", "similarity")
    return long.select(
        key, F.regexp_extract("col", r"s_(\d+)", 1).cast("int").alias("step"), F.round("similarity", 6).alias("similarity")
    )


#: Rows of a block of either side of a rectangular product; a cell multiplies two blocks.
BLOCK_ROWS = 4_096


def top_similar(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vec: str = "embedding") -> DataFrame:
    """Rectangular similarity of two vector tables: left_id, rank (from 1), right_id, similarity, for every
    left row its k most similar right rows by dot product (cosine for normalised vectors).

    Both sides are dealt into blocks; the grid of (left block, right block) cells is an equi-join
    on the block numbers, a cell is one dense product in one task, and it passes on k rows per left row,
    which the last step merges.  A row is sent once per block of the other side; no pair of rows is ever a
    row of a table.  Equal similarities go by right_id; rows without id or vector, and vectors of another
    length than their cell's, take no part; fewer than k right rows give all."""
    both = {}
    for name, df, key in (("l", left, left_id), ("r", right, right_id)):
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
        both[name] = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))
    blocks = {name: max(1, -(-df.count() // BLOCK_ROWS)) for name, df in both.items()}
    dealt = lambda name: F.pmod(F.xxhash64("id"), F.lit(blocks[name])).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(blocks[name] - 1)))
    cell = ["dim", "row", "col"]
    lhs = both["l"].select("dim", dealt("l").alias("row"), every("r").alias("col"), "id", "v").groupBy(*cell)
    rhs = both["r"].select("dim", every("l").alias("row"), dealt("r").alias("col"), "id", "v").groupBy(*cell)

    def product(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out = {"left": [], "right": [], "similarity": []}
        if len(a) and len(b):
            ids, others = a["id"].to_numpy(), b["id"].to_numpy()
            order = np.argsort(others, kind="stable")
            others, y = others[order], matrix(b)[order].T
            x, n = matrix(a), min(k, len(order))
            for at in range(0, len(ids), 512):
                scores = np.round(x[at : at + 512] @ y, 9)  # the order of summation must not decide a tie
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                out["left"].append(np.repeat(ids[at : at + 512], n))
                out["right"].append(others[best].ravel())
                out["similarity"].append(np.take_along_axis(scores, best, axis=1).ravel())
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out.values()]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(out, columns, types, strict=True)})

    found = lhs.cogroup(rhs).applyInArrow(product, "left long, right long, similarity double")
    best = Window.partitionBy("left").orderBy(F.desc("similarity"), "right")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("left").alias(left_id), "rank", F.col("right").alias(right_id), F.round("similarity", 6).alias("similarity"))


# --- PCA ----------------------------------------------------------------------------

def pca(emb: DataFrame, k: int = 5, vec: str = "embedding"):
    """Spark ML PCA (covariance by a distributed tree aggregate, eigen-
    decomposition of the d x d matrix on the driver).  Returns the model with
    a canonical sign: each component's largest-magnitude loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = emb.select(array_to_vector(F.col(vec)).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(v)
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), range(pc.shape[1])])
    signs[signs == 0] = 1
    fixed = pc * signs
    return model, fixed, np.array(model.explainedVariance.toArray())


def pca_loadings(spark, fixed: np.ndarray, explained: np.ndarray) -> DataFrame:
    rows = [
        (j + 1, i, float(round(fixed[i, j], 6)), float(round(explained[j], 6)))
        for j in range(fixed.shape[1])
        for i in range(fixed.shape[0])
    ]
    return spark.createDataFrame(rows, "pc int, dim int, loading double, explained_variance double")


def pca_scores(emb: DataFrame, fixed: np.ndarray, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Uncentred scores x . pc_j (the reference projects raw vectors)."""
    cols = [F.round(dot_literal(vec, fixed[:, j]), 6).alias(f"pc{j + 1}_score") for j in range(fixed.shape[1])]
    return emb.select(key, *cols)


def pc_extremes(scores: DataFrame, k_pc: int, n: int = 10, key: str = "vec_id", carry=("text",)) -> DataFrame:
    """Top and bottom ``n`` rows per component.  ``row_number() <= n`` is
    planned with a partial per-task limit before the shuffle
    (WindowGroupLimit), so only n rows per task and component move."""
    ids = [key] + [c for c in carry if c in scores.columns]
    long = scores.unpivot(ids, [f"pc{j + 1}_score" for j in range(k_pc)], "pc", "score")
    w_top = Window.partitionBy("pc").orderBy(F.desc("score"), key)
    w_bot = Window.partitionBy("pc").orderBy(F.asc("score"), key)
    top = long.withColumn("rank", F.row_number().over(w_top)).where(F.col("rank") <= n).withColumn("end", F.lit("top"))
    bot = long.withColumn("rank", F.row_number().over(w_bot)).where(F.col("rank") <= n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bot)


def covariance(emb: DataFrame, vec: str = "embedding") -> np.ndarray:
    """d x d sample covariance by Spark ML's distributed aggregate (bounded by the dimension)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import PCA

    v = emb.select(array_to_vector(F.col(vec)).alias("features"))
    d = len(v.first()["features"])
    model = PCA(k=d, inputCol="features", outputCol="scores").fit(v)
    share, axes = model.explainedVariance.toArray(), model.pc.toArray()
    total = total_variance(emb, vec=vec).first()["total_variance"]
    n = emb.count()
    return axes @ np.diag(share * total * n / (n - 1)) @ axes.T


def residual_maps(plan: AnchorPlan) -> list[np.ndarray]:
    """For each step, M with residual = x M before that step (kept steps before it deflated)."""
    d = plan.anchors.shape[1]
    out = []
    for s in range(len(plan.steps)):
        kept = [t for t in range(s) if plan.keep[t]]
        out.append(np.eye(d) - plan.b[kept].T @ plan.anchors[kept] if kept else np.eye(d))
    return out


def residual_components(emb: DataFrame, plan: AnchorPlan, k: int = 5, vec: str = "embedding"):
    """The k leading components of each step's residuals: (share of the total variance, axes
    as rows, axes on the raw vectors as rows).

    The residuals are a linear map of the vectors, so one covariance of the raw
    vectors gives the components of every step; nothing is deflated in the data."""
    cov = covariance(emb, vec)
    total = np.trace(cov)
    out = []
    for m in residual_maps(plan):
        values, axes = np.linalg.eigh(m.T @ cov @ m)
        top = np.argsort(-values)[:k]
        pcs = axes[:, top].T
        pcs *= np.sign(pcs[np.arange(len(top)), np.abs(pcs).argmax(axis=1)])[:, None]
        out.append((values[top] / total, pcs, pcs @ m.T))
    return out


def residual_extremes(emb: DataFrame, texts: DataFrame, components, steps, n: int = 10, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Per step and component: the n highest and n lowest uncentred scores, with their texts."""
    cols = [
        dot_literal(vec, raw[j]).alias(f"s{s}_pc{j + 1}")
        for s, (_, _, raw) in zip(steps, components, strict=True)
        for j in range(len(raw))
    ]
    names = [f"s{s}_pc{j + 1}" for s, (_, _, raw) in zip(steps, components, strict=True) for j in range(len(raw))]
    long = emb.select(key, *cols).unpivot([key], names, "name", "score")
    ends = []
    for end, order in (("top", F.desc("score")), ("bottom", F.asc("score"))):
        w = Window.partitionBy("name").orderBy(order, key)
        ends.append(long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("end", F.lit(end)))
    best = ends[0].unionByName(ends[1])
    step = F.regexp_extract("name", r"s(\d+)_pc(\d+)", 1).cast("int")
    pc = F.regexp_extract("name", r"s(\d+)_pc(\d+)", 2).cast("int")
    return texts.join(F.broadcast(best), key).select(  # steps x components x 2n rows
        step.alias("step"), pc.alias("pc"), "end", "rank", key, F.round("score", 6).alias("score"), "text"
    )


def dims_to_vector(df: DataFrame, prefix: str = "dim_", vec: str = "embedding") -> DataFrame:
    """Wide columns ``dim_0, dim_1, ...`` (any order) as one array column."""
    dims = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))
    rest = [c for c in df.columns if c not in dims]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in dims]).alias(vec))


def anchor_words(answers: DataFrame, words: str = "words") -> DataFrame:
    """One row per word of a comma-separated answer, trimmed, with its position from 1; the
    first names the dimension."""
    parts = F.transform(F.split(words, ","), lambda w: F.trim(w))
    rest = [c for c in answers.columns if c != words]
    rows = answers.select(*rest, parts.alias("_w"), F.posexplode(parts).alias("_at", "word"))
    return rows.select(*rest, (F.col("_at") + 1).alias("position"), "word", F.element_at("_w", 1).alias("name"))
