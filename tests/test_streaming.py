import pytest
from pyspark.sql import functions as F

from convoscope.operators import sets as so
from convoscope.plans import fixtures as fx
from convoscope.plans import q_sets
from convoscope.streaming.set_stream import run_to_completion, stage_members, start_set_summaries
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.select("set_id", "n_pairs", "mean_similarity", "max_similarity", "median_similarity").collect())


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    members = fx.sets_f(spark, SF_SMALL)
    root = str(tmp_path)
    first = members.where("set_id < 20")
    stage_members(first, f"{root}/m", sets_per_file=10)
    run_to_completion(start_set_summaries(spark, f"{root}/m", f"{root}/out", f"{root}/ck"))
    got1 = spark.read.parquet(f"{root}/out")
    assert got1.select("batch_id").distinct().count() == 2  # one micro-batch per file
    # new files arrive; the restarted stream only processes those
    rest = members.where("set_id >= 20").withColumn("chunk", (members.set_id / 10).cast("int"))
    rest.write.mode("append").partitionBy("chunk").parquet(f"{root}/m")
    run_to_completion(start_set_summaries(spark, f"{root}/m", f"{root}/out", f"{root}/ck"))
    got = spark.read.parquet(f"{root}/out")
    exp = so.set_summary(so.set_pairs(members))
    assert _rows(got) == _rows(exp)


def test_a_set_in_parts_is_refused(spark, tmp_path):
    members = fx.sets_f(spark, SF_SMALL).where("set_id = 3")
    for k, half in enumerate(("idx < 8", "idx >= 8")):
        members.where(half).write.parquet(f"{tmp_path}/m/chunk={k}")
    q = start_set_summaries(spark, f"{tmp_path}/m", f"{tmp_path}/out", f"{tmp_path}/ck", set_size=16)
    with pytest.raises(Exception, match="of 16 members"):
        run_to_completion(q)


def test_micro_batches_by_bytes_hold_whole_sets(spark, tmp_path):
    members = fx.sets_f(spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file per partition
    try:
        stage_members(members, f"{tmp_path}/m", sets_per_file=2, packed=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")]
    assert 2 < len(sizes) < 16  # 32 sets, 16 chunks
    files = spark.read.parquet(f"{tmp_path}/m").select("set_id", F.input_file_name().alias("file"))
    assert files.distinct().count() == files.select("set_id").distinct().count() == 32
    batches = {}
    for name, most in (("few", sum(sizes) // 2), ("one", sum(sizes))):
        run_to_completion(start_set_summaries(spark, f"{tmp_path}/m", f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}", bytes_per_batch=most))
        got = spark.read.parquet(f"{tmp_path}/{name}")
        batches[name] = got.select("batch_id").distinct().count()
        assert _rows(got) == _rows(so.set_summary(so.set_pairs(members)))
    assert batches["one"] == 1 < batches["few"] < len(sizes)


def test_the_query_s_micro_batches_grow_with_bytes_only(spark, monkeypatch):
    seen, read = [], q_sets.bt.read_batches

    def counting(spark, root):
        out = read(spark, root)
        seen.append(out.select("batch_id").distinct().count())
        return out

    monkeypatch.setattr(q_sets.bt, "read_batches", counting)
    assert q_sets.q_set_summary_stream(spark, SF_SMALL).count() == 32
    assert seen == [1]  # 32 sets in chunks of 25, far below MICRO_BATCH_BYTES
