import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from convoscope.sources import csv as cs


def _write(p, text):
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def test_quoted_comma_and_non_ascii(spark, tmp_path):
    _write(tmp_path / "d1" / "conditions.csv", 'condition_id,full_cite\n1,"Smith, J. – a study"\n')
    df = cs.read_table(spark, str(tmp_path), "d1", "conditions")
    assert df.collect()[0]["full_cite"] == "Smith, J. – a study"


def test_strict_reader(spark, tmp_path):
    with pytest.raises(ValueError):
        cs.read_table(spark, str(tmp_path), None, "x")
    with pytest.raises(ValueError):
        cs.read_table(spark, str(tmp_path), "d", None)
    with pytest.raises(AnalysisException):
        cs.read_table(spark, str(tmp_path), "nope", "messages").collect()


def test_header_only_file_keeps_schema(spark, tmp_path):
    _write(tmp_path / "y" / "choices.csv", "choice_id,player_id,role,time_stamp,trial_id,option_set,check_choices\n")
    schema = "choice_id int, player_id string, role string, time_stamp timestamp, trial_id string, option_set string, check_choices string"
    df = cs.read_table(spark, str(tmp_path), "y", "choices", schema=schema)
    assert df.count() == 0 and len(df.columns) == 7


def test_skip_long_lines_keep_short(spark, tmp_path):
    _write(tmp_path / "m.csv", "a,b,c\n1,x,y\n2,x\n3,x,y,z\n")
    schema = StructType([StructField("a", IntegerType()), StructField("b", StringType()), StructField("c", StringType())])
    rows = sorted(tuple(r) for r in cs.read_skip_long_lines(spark, str(tmp_path / "m.csv"), schema).collect())
    assert rows == [(1, "x", "y"), (2, "x", None)]


def test_multi_dataset_scan_labels_and_discovery(spark, tmp_path):
    for d in ("alpha", "beta"):
        _write(tmp_path / d / "messages.csv", "trial_id,text\n1,hi\n")
    df = cs.read_all(spark, str(tmp_path), "messages", schema="trial_id int, text string")
    assert sorted(r["dataset_id"] for r in df.collect()) == ["alpha", "beta"]
    assert sorted(r[0] for r in cs.discover_datasets(spark, str(tmp_path), "messages").collect()) == ["alpha", "beta"]
    assert cs.count_files(spark, str(tmp_path)) == 2
    one = cs.read_all(spark, str(tmp_path), "messages", schema="trial_id int, text string", datasets=["beta"])
    assert [r["dataset_id"] for r in one.collect()] == ["beta"]


def test_csv_sink_writes_missing_as_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    out = str(tmp_path / "o")
    cs.write_csv(df.coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert "1,\n" in text and '""' not in text


def test_headerless_positional_slice(spark, tmp_path):
    _write(tmp_path / "map.csv", "0,3,4\n1,5,6\n")
    df = cs.read_headerless(spark, str(tmp_path / "map.csv"))
    assert [tuple(r) for r in df.collect()] == [(3, 4), (5, 6)]


def test_read_all_unites_by_name(spark, tmp_path):
    from convoscope.sources.csv import read_all

    for name, body in {
        "a": "trial_id,text,role\n1,hello,describer\n",
        "b": 'trial_id,role,text\n2,matcher,"x, y"\n',
        "c": "trial_id,text,role,extra\n3,bye,matcher,more\n",
        "d": "role,trial_id\ndescriber,4\n",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "messages.csv").write_text(body)
    want = {(1, "hello", "describer", None, "a"), (2, "x, y", "matcher", None, "b"), (3, "bye", "matcher", "more", "c"), (4, None, "describer", None, "d")}
    for schema in (None, "trial_id int, text string, role string"):
        df = read_all(spark, str(tmp_path), "messages", schema)
        assert {(r.trial_id, r.text, r.role, r.extra, r.dataset_id) for r in df.collect()} == want
    some = read_all(spark, str(tmp_path), "messages", "trial_id int, text string, role string", datasets=["b", "d"])
    assert {r.dataset_id for r in some.collect()} == {"b", "d"}


def test_discovery_finds_files_and_folders_of_part_files(spark, tmp_path):
    schema = "trial_id int, text string"
    for name, rows in {"one": [(1, "a"), (2, "b")], "two": [(3, 'quoted, "c"')]}.items():
        cs.write_csv(spark.createDataFrame(rows, schema).repartition(2), f"{tmp_path}/{name}/messages.csv")
    _write(tmp_path / "three" / "messages.csv", "trial_id,text\n4,d\n")
    _write(tmp_path / "four" / "other_messages.csv", "trial_id,text\n5,e\n")
    assert sorted(r[0] for r in cs.discover_datasets(spark, str(tmp_path), "messages").collect()) == ["one", "three", "two"]
    got = {tuple(r) for r in cs.read_all(spark, str(tmp_path), "messages", schema).collect()}
    assert got == {(1, "a", "one"), (2, "b", "one"), (3, 'quoted, "c"', "two"), (4, "d", "three")}
    with pytest.raises(FileNotFoundError):
        cs.read_all(spark, str(tmp_path), "nothing", schema)


def test_manifest_names_what_is_to_run_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from convoscope.sources import batches as bt

    def plan(rows):
        df = spark.createDataFrame(rows, "set_id int, x double").repartition(3)
        return df, bt.batch_plan(df, F.floor(F.col("set_id") / 10).cast("int"), "set_id", ["set_id", "x"])

    rows = [(k, k * 0.5) for k in range(45)]
    df, planned = plan(rows)
    assert {r.batch_id: r.expected for r in planned.collect()} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 5}
    data, manifest = f"{tmp_path}/data", f"{tmp_path}/manifest"
    out = df.withColumn("batch_id", F.floor(F.col("set_id") / 10).cast("int"))
    bt.write_batches(out.where("batch_id < 3 AND set_id <> 25"), data)  # batch 2 lost a set, 3 and 4 never ran
    bt.record_batches(planned, bt.read_batches(spark, data), manifest)
    pending = lambda p: sorted(r.batch_id for r in bt.pending_by_manifest(p, spark.read.parquet(manifest)).collect())
    assert pending(planned) == [2, 3, 4]
    assert pending(plan(rows[::-1])[1]) == [2, 3, 4]  # the order of rows changes nothing
    assert pending(plan([(k, x + (k == 7)) for k, x in rows])[1]) == [0, 2, 3, 4]  # a changed input reruns its batch
    bt.write_batches(out.where("batch_id >= 2"), data)
    bt.record_batches(planned, bt.read_batches(spark, data), manifest)
    assert pending(planned) == []
    assert pending(plan(rows[:-1])[1]) == [4]
