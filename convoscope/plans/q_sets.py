"""Image-set query keys over ``sets_f`` (members with vectors) and
``shapes_f`` (items to sample from)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoscope.operators import sets as so
from convoscope.operators.joins import attach_row
from convoscope.plans import fixtures as fx
from convoscope.plans.registry import register
from convoscope.session import shared_path
from convoscope.sources import batches as bt

N_SETS = 100  # sets generated per type (the default job size)
SET_SIZE = 16
BATCH_SIZE = 25
MICRO_BATCH_BYTES = 64 << 20
LOOKUP = (3, 5, 2)  # set 3, pair (5, 2) -> normalised to (2, 5)
SAMPLE_N = 10


def pairs_df(spark, sf_dir):
    return so.set_pairs(fx.sets_f(spark, sf_dir))


_PAIRS_SQL = """, pairs AS (SELECT a.set_id, a.set_type, a.idx AS i, b.idx AS j,
   list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
   FROM sets_f a JOIN sets_f b ON a.set_id = b.set_id AND a.idx < b.idx),
 mx AS (SELECT set_id, set_type, max(similarity) AS max_similarity FROM pairs GROUP BY set_id, set_type),
 med AS (SELECT set_type, median(max_similarity) AS median_max FROM mx GROUP BY set_type),
 sel AS (SELECT mx.*, med.median_max, mx.max_similarity < med.median_max AS kept FROM mx JOIN med USING (set_type))
"""


def _sql(body: str, *rounded: str) -> str:
    """``body`` over the pairs; the columns ``rounded`` are rounded in its result, and only there."""
    if rounded:
        body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({body})"
    return fx.with_views("", "sets_f").rstrip() + _PAIRS_SQL + body


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@register("set_pairs", _sql("SELECT * FROM pairs", "similarity"), bench=True)
def q_set_pairs(spark, sf_dir):
    return _rounded(pairs_df(spark, sf_dir))


@register(
    "set_ranked_pairs",
    _sql(
        """SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY similarity DESC, i, j) AS rank_desc,
  row_number() OVER (PARTITION BY set_id ORDER BY similarity ASC, i, j) AS rank_asc FROM pairs""",
        "similarity",
    ),
)
def q_set_ranked_pairs(spark, sf_dir):
    return _rounded(so.ranked_pairs(pairs_df(spark, sf_dir)))


@register(
    "set_topk_pairs",
    _sql(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY similarity DESC, i, j) AS rank FROM pairs) WHERE rank <= 2",
        "similarity",
    ),
)
def q_set_topk_pairs(spark, sf_dir):
    return _rounded(so.topk_pairs(pairs_df(spark, sf_dir), n=2))


@register(
    "set_pair_lookup",
    _sql(f"SELECT * FROM pairs WHERE set_id = {LOOKUP[0]} AND i = {min(LOOKUP[1:])} AND j = {max(LOOKUP[1:])}", "similarity"),
)
def q_set_pair_lookup(spark, sf_dir):
    return _rounded(so.pair_lookup(pairs_df(spark, sf_dir), *LOOKUP))


_SUMMARY_SQL = """SELECT set_id, set_type, count(*) AS n_pairs, avg(similarity) AS mean_similarity, min(similarity) AS min_similarity,
  max(similarity) AS max_similarity, quantile_disc(similarity, 0.5) AS median_similarity FROM pairs GROUP BY set_id, set_type"""


_SUMMARY_ROUNDED = ("mean_similarity", "min_similarity", "max_similarity", "median_similarity")


@register("set_summary", _sql(_SUMMARY_SQL, *_SUMMARY_ROUNDED))
def q_set_summary(spark, sf_dir):
    return _rounded(so.set_summary(pairs_df(spark, sf_dir)))


@register(
    "global_pair_median",
    _sql("SELECT set_type, count(*) AS n_pairs, quantile_disc(similarity, 0.5) AS median_similarity FROM pairs GROUP BY set_type", "median_similarity"),
)
def q_global_pair_median(spark, sf_dir):
    return _rounded(so.global_pair_median(pairs_df(spark, sf_dir)))


@register(
    "sim_histogram",
    _sql(
        """, rng AS (SELECT set_type, min(max_similarity) AS vmin, max(max_similarity) AS vmax FROM mx GROUP BY set_type),
 c AS (SELECT m.set_type, CAST(CASE WHEN (r.vmax - r.vmin) / 10.0 = 0 THEN 0 ELSE least(floor((m.max_similarity - r.vmin) / ((r.vmax - r.vmin) / 10.0)), 9) END AS INTEGER) AS bin, count(*) AS count
   FROM mx m JOIN rng r USING (set_type) GROUP BY ALL),
 g AS (SELECT set_type, vmin, vmax, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM rng)
SELECT g.set_type, g.bin, round(g.vmin + g.bin * ((g.vmax - g.vmin) / 10.0), 6) AS lo, round(g.vmin + (g.bin + 1) * ((g.vmax - g.vmin) / 10.0), 6) AS hi,
  coalesce(c.count, 0) AS count FROM g LEFT JOIN c ON g.set_type = c.set_type AND g.bin = c.bin"""
    ),
)
def q_sim_histogram(spark, sf_dir):
    return _rounded(so.histogram(so.set_maxima(pairs_df(spark, sf_dir)), "max_similarity", "set_type", bins=10))


@register("set_select", _sql("SELECT * FROM sel", "max_similarity", "median_max"))
def q_set_select(spark, sf_dir):
    return _rounded(so.set_select(pairs_df(spark, sf_dir)))


@register(
    "set_kept_stats",
    _sql(
        """SELECT set_type, CAST(count_if(kept) AS BIGINT) AS n_kept, CAST(count_if(NOT kept) AS BIGINT) AS n_rejected,
  avg(CASE WHEN kept THEN max_similarity END) AS mean_kept_max, min(CASE WHEN kept THEN max_similarity END) AS min_kept_max,
  max(CASE WHEN kept THEN max_similarity END) AS max_kept_max FROM sel GROUP BY set_type""",
        "mean_kept_max",
        "min_kept_max",
        "max_kept_max",
    ),
)
def q_set_kept_stats(spark, sf_dir):
    return _rounded(so.kept_stats(so.set_select(pairs_df(spark, sf_dir))))


@register(
    "set_sample",
    _sql(
        f"""SELECT set_type, set_id, rank FROM (SELECT set_type, set_id, row_number() OVER (PARTITION BY set_type ORDER BY md5('42:' || CAST(set_id AS VARCHAR)), set_id) AS rank
  FROM sel WHERE kept) WHERE rank <= {SAMPLE_N}"""
    ),
)
def q_set_sample(spark, sf_dir):
    return so.sample_sets(so.set_select(pairs_df(spark, sf_dir)), n=SAMPLE_N)


def _written_summaries(spark, sf_dir):
    """Set summaries written batch by batch to the shared folder (idempotent
    per batch), then read back from storage."""
    summ = so.set_summary(pairs_df(spark, sf_dir)).withColumn("batch_id", so.batch_of("set_id", BATCH_SIZE))
    root = shared_path(spark, "set_batches", uuid.uuid4().hex)
    bt.write_batches(summ, root)
    return bt.read_batches(spark, root)


@register(
    "set_batches",
    _sql(
        f""", b AS (SELECT CAST(floor(set_id / {BATCH_SIZE}) AS INTEGER) AS batch_id, set_id FROM (SELECT DISTINCT set_id FROM pairs))
SELECT batch_id, count(*) AS n_sets, min(set_id) AS first_set, max(set_id) AS last_set, (SELECT max(batch_id) FROM b) AS newest_batch FROM b GROUP BY batch_id"""
    ),
)
def q_set_batches(spark, sf_dir):
    back = _written_summaries(spark, sf_dir)
    per = back.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_sets"), F.min("set_id").alias("first_set"), F.max("set_id").alias("last_set")
    )
    return attach_row(per, bt.newest_batch(back))


#: Batches of the pending key that the run left out (every third), and those it wrote by half (every fifth).
LEFT_OUT, HALF = 3, 5


@register(
    "set_pending_batches",
    _sql(
        f"""SELECT batch_id, expected FROM (
   SELECT CAST(floor(set_id / {BATCH_SIZE}) AS INTEGER) AS batch_id, count(DISTINCT set_id) AS expected FROM pairs GROUP BY ALL)
WHERE batch_id % {LEFT_OUT} = 1 OR (batch_id % {HALF} = 0 AND expected > 1)"""
    ),
)
def q_set_pending_batches(spark, sf_dir):
    """A run that was cut short: the plan comes from all sets of the input, some batches were never
    written, some hold every second set only, and the manifest names what is whole."""
    # rounded, so that a mean summed in another order has the same fingerprint
    summ = _rounded(so.set_summary(pairs_df(spark, sf_dir))).withColumn("batch_id", so.batch_of("set_id", BATCH_SIZE)).checkpoint()
    plan = bt.batch_plan(summ, F.col("batch_id"), "set_id", [c for c in summ.columns if c != "batch_id"]).checkpoint()
    root = shared_path(spark, "set_batches", uuid.uuid4().hex)
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("set_id"))  # BATCH_SIZE rows each
    run = summ.withColumn("place", place).where(f"batch_id % {LEFT_OUT} <> 1 AND (batch_id % {HALF} <> 0 OR place % 2 = 1)").drop("place")
    bt.write_batches(run, f"{root}/data")
    bt.record_batches(plan, bt.read_batches(spark, f"{root}/data"), f"{root}/manifest")
    return bt.pending_by_manifest(plan, spark.read.parquet(f"{root}/manifest")).select("batch_id", "expected")


def _gen_sql(kind: str) -> str:
    q = 4 if kind == "comp" else SET_SIZE
    k = 2 * q
    seed = f"42{kind}"
    head = fx.with_views("", "shapes_f").rstrip()
    ranked = f""", p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM shapes_f),
 dr AS (SELECT CAST(s.range AS INTEGER) AS set_id, min(d.range) AS draw,
   CAST('0x' || substr(md5('{seed}:' || CAST(s.range AS VARCHAR) || ':' || CAST(d.range AS VARCHAR)), 1, 12) AS BIGINT) % (SELECT count(*) FROM shapes_f) AS place
   FROM range(0, {N_SETS}) s, range(0, {4 * k}) d GROUP BY ALL),
 r AS (SELECT set_id, item_id, row_number() OVER (PARTITION BY set_id ORDER BY draw) AS rk FROM dr JOIN p USING (place)),
 tops AS (SELECT set_id, item_id AS top, rk AS ti FROM r WHERE rk <= {q}),
 bottoms AS (SELECT set_id, item_id AS bottom, rk - {q} AS bi FROM r WHERE rk > {q} AND rk <= {k})
"""
    if kind == "comp":
        body = f"""SELECT t.set_id, CAST((t.ti - 1) * {q} + (b.bi - 1) AS INTEGER) AS idx, t.top, b.bottom,
  CAST(t.top AS VARCHAR) || '_' || CAST(b.bottom AS VARCHAR) || '.png' AS image FROM tops t JOIN bottoms b ON t.set_id = b.set_id"""
    else:
        body = f"""SELECT t.set_id, CAST(t.ti - 1 AS INTEGER) AS idx, t.top, b.bottom,
  CAST(t.top AS VARCHAR) || '_' || CAST(b.bottom AS VARCHAR) || '.png' AS image FROM tops t JOIN bottoms b ON t.set_id = b.set_id AND t.ti = b.bi"""
    return head + ranked + body


@register("gen_sets_comp", _gen_sql("comp"))
def q_gen_sets_comp(spark, sf_dir):
    return so.gen_sets_comp(fx.shapes_f(spark, sf_dir), N_SETS, SET_SIZE, seed="42comp")


@register("gen_sets_noncomp", _gen_sql("noncomp"))
def q_gen_sets_noncomp(spark, sf_dir):
    return so.gen_sets_noncomp(fx.shapes_f(spark, sf_dir), N_SETS, SET_SIZE, seed="42noncomp")


@register("set_summary_stream", _sql(_SUMMARY_SQL, *_SUMMARY_ROUNDED))
def q_set_summary_stream(spark, sf_dir):
    """The set summaries computed incrementally: members staged as files of
    whole sets in the shared folder, consumed by a file-source stream
    (files of up to 64 MB per micro-batch, availableNow), summaries written per batch."""
    from convoscope.streaming.set_stream import run_to_completion, stage_members, start_set_summaries

    root = shared_path(spark, "set_stream", uuid.uuid4().hex)
    stage_members(fx.sets_f(spark, sf_dir), f"{root}/members", sets_per_file=BATCH_SIZE, packed=True)
    q = start_set_summaries(
        spark, f"{root}/members", f"{root}/summaries", f"{root}/_checkpoint", max_set_size=SET_SIZE, bytes_per_batch=MICRO_BATCH_BYTES
    )
    run_to_completion(q)
    return _rounded(bt.read_batches(spark, f"{root}/summaries").drop("batch_id"))
