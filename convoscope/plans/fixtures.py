"""Fixture views over the driver tables (definitions in FIXTURES.md §3).

Each view is built twice: as DataFrame code for ``queries()`` and as the SQL
text the DuckDB oracle prefixes as a ``WITH`` clause.  The two must agree row
for row; ``tests/test_fixtures.py`` checks that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoscope.sources.tables import table


def _g(conv_id):
    return F.floor(conv_id / F.lit(6.0)).cast("bigint")


def _p(num):
    return F.concat(F.lit("p"), (num % 4).cast("string"))


def conditions_f(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    rows = [
        ("p0", 1, 2, "thin", "English"),
        ("p0", 2, 6, "thick", "English"),
        ("p1", 1, 4, "network-swap", "English"),
        ("p1", 2, 2, None, "English"),
        ("p2", 1, 2, "medium", "English"),
        ("p2", 2, 6, "med_thick", "English"),
        ("p3", 1, 4, "naive-swap", "English"),
        ("p3", 2, 3, "star", "English"),
    ]
    return spark.createDataFrame(
        rows, "dataset_id string, condition_id int, group_size int, structure string, language string"
    )


def trials_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    x = conv.select(F.col("conv_id").alias("trial_id")).distinct()
    x = x.select("trial_id", _g(F.col("trial_id")).alias("g"))
    return x.select(
        _p(F.col("g")).alias("dataset_id"),
        "trial_id",
        F.concat(F.lit("g"), F.col("g").cast("string"), F.lit("_room1")).alias("game_id"),
        (F.col("g") % 3 + 1).cast("int").alias("condition_id"),
        (F.col("trial_id") % 6 + 1).cast("int").alias("rep_num"),
        (F.col("trial_id") % 72 + 1).cast("int").alias("trial_num"),
        F.when(F.col("g") % 5 == 0, 2).otherwise(1).cast("int").alias("stage_num"),
        F.substring(F.lit("ABCDEFGHIJKLMN"), (F.col("g") % 14).cast("int") + 1, 1).alias("target"),
        F.expr("substring('A;B;C;D;E;F', 1, CAST(2 * (trial_id % 6) + 1 AS INT))").alias("option_set"),
    )


def messages_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    return conv.select(
        _p(_g(F.col("conv_id"))).alias("dataset_id"),
        F.col("conv_id").alias("trial_id"),
        F.col("turn").alias("message_number"),
        (F.col("conv_id") * 10 + F.col("turn") % 2).alias("player_id"),
        F.when(F.col("role") == "user", "describer")
        .when(F.col("role") == "assistant", "matcher")
        .otherwise(F.col("role"))
        .alias("role"),
        "text",
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("message_irrelevant"),
    )


def choices_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    g = _g(F.col("conv_id"))
    return conv.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("choice_id"),
        _p(g).alias("dataset_id"),
        F.col("conv_id").alias("trial_id"),
        (F.col("conv_id") * 10 + F.col("turn") % 2).alias("player_id"),
        F.expr("substring('A;B;C;D;E;F', 1, CAST(2 * (conv_id % 6) + 1 AS INT))").alias("option_set"),
        F.substring(F.lit("ABCDEF"), ((F.col("conv_id") + F.col("turn")) % 6).cast("int") + 1, 1).alias("choice"),
    )


def _rep_num():
    """Round of an event: twice as many rounds where the structure is network-swap."""
    per_day = F.when(F.col("user_id") % 4 == 2, 2.5).otherwise(5.0)
    return (F.floor((F.dayofmonth("ts") - 1) / per_day).cast("int") + 1).alias("rep_num")


def _target():
    return F.substring(F.lit("ABCDEFGHIJKL"), (F.col("event_id") % 12).cast("int") + 1, 1).alias("target")


def _game_cols():
    uid = F.col("user_id")
    return [
        uid.alias("game_id"),
        F.concat(F.lit("p"), (uid % 4).cast("string")).alias("paper_id"),
        "target",
        F.when(uid % 4 == 0, "thin").when(uid % 4 == 1, "thick").when(uid % 4 == 2, "network-swap").alias("structure"),
        (uid % 3 * 2 + 2).cast("int").alias("group_size"),
        F.lit(1).cast("int").alias("stage_num"),
    ]


def rounds_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a message; a game is a user, a trial one of its targets in one round."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _rep_num(), _target())
    uid, n = F.col("user_id"), F.col("event_id")
    return ev.select(
        *_game_cols(),
        "rep_num",
        ((F.col("rep_num") - 1) * 12 + n % 12 + 1).cast("int").alias("trial_num"),
        n.alias("message_number"),
        F.when(uid % 4 == 2, uid * 10 + n % 3).otherwise(uid * 10).alias("player_num"),
        F.when((uid % 7 == 0) & (n % 5 == 0), "matcher").otherwise("describer").alias("role"),
        F.col("event_type").alias("text"),
    )


def to_next_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "value", _rep_num(), _target()).where(F.col("rep_num") > 1)
    agg = ev.groupBy("user_id", "target", "rep_num").agg(
        (
            F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
            / (F.count(F.lit(1)) * 100000).cast("double")
        ).alias("sim")
    )
    return agg.select(*_game_cols(), F.col("rep_num").alias("later"), "sim")


def docs_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    for old, new in [
        (" by ", " maybe "),
        (" at ", " looks like "),
        (" from ", " unlikely "),
        (" with ", " she "),
        (" for ", " they "),
        (" as ", " your "),
    ]:
        t = F.replace(t, F.lit(old), F.lit(new))
    doc = F.col("doc_id")
    return d.select(
        doc,
        F.concat(F.lit("p"), (doc % 4).cast("string")).alias("dataset_id"),
        (doc % 6 + 1).cast("int").alias("rep_num"),
        F.substring(F.lit("ABCDEFGHIJKLMN"), (doc % 14).cast("int") + 1, 1).alias("target"),
        F.when(doc % 3 == 0, "matcher").otherwise("describer").alias("role"),
        t.alias("text"),
    )


def sets_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    set_id = F.floor(F.col("vec_id") / F.lit(16.0)).cast("bigint")
    return e.select(
        set_id.alias("set_id"),
        (F.col("vec_id") % 16).cast("int").alias("idx"),
        F.when(set_id % 2 == 0, "comp").otherwise("noncomp").alias("set_type"),
        "embedding",
    )


def shapes_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))


ANCHOR_ROWS = [
    (1, "dim_a", 0, True),
    (1, "dim_a", 1, True),
    (2, "dim_b", 2, False),
    (3, "dim_c", 3, True),
    (3, "dim_c", 4, True),
]


def anchors_f(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame(ANCHOR_ROWS, "step int, name string, label int, keep boolean")


# --- SQL text of the same views, for the DuckDB oracle ---------------------

SQL = {
    "conditions_f": """SELECT * FROM (VALUES ('p0',1,2,'thin','English'),('p0',2,6,'thick','English'),('p1',1,4,'network-swap','English'),('p1',2,2,CAST(NULL AS VARCHAR(20)),'English'),('p2',1,2,'medium','English'),('p2',2,6,'med_thick','English'),('p3',1,4,'naive-swap','English'),('p3',2,3,'star','English')) t(dataset_id,condition_id,group_size,structure,language)""",
    "trials_f": """SELECT dataset_id, trial_id, concat('g', CAST(g AS VARCHAR(20)), '_room1') AS game_id, CAST(g % 3 + 1 AS INT) AS condition_id, CAST(trial_id % 6 + 1 AS INT) AS rep_num, CAST(trial_id % 72 + 1 AS INT) AS trial_num, CAST(CASE WHEN g % 5 = 0 THEN 2 ELSE 1 END AS INT) AS stage_num, substring('ABCDEFGHIJKLMN', CAST(g % 14 AS INT) + 1, 1) AS target, substring('A;B;C;D;E;F', 1, CAST(2 * (trial_id % 6) + 1 AS INT)) AS option_set
  FROM (SELECT DISTINCT conv_id AS trial_id, CAST(floor(conv_id / 6.0) AS BIGINT) AS g, concat('p', CAST(CAST(floor(conv_id / 6.0) AS BIGINT) % 4 AS VARCHAR(20))) AS dataset_id
  FROM conversations) x""",
    "messages_f": """SELECT concat('p', CAST(CAST(floor(conv_id / 6.0) AS BIGINT) % 4 AS VARCHAR(20))) AS dataset_id, conv_id AS trial_id, turn AS message_number, conv_id * 10 + turn % 2 AS player_id, CASE role WHEN 'user' THEN 'describer' WHEN 'assistant' THEN 'matcher' ELSE role END AS role, text, CASE WHEN (conv_id + turn) % 5 = 0 THEN true WHEN (conv_id + turn) % 5 = 1 THEN false END AS message_irrelevant
  FROM conversations""",
    "choices_f": """SELECT conv_id * 100 + turn AS choice_id, concat('p', CAST(CAST(floor(conv_id / 6.0) AS BIGINT) % 4 AS VARCHAR(20))) AS dataset_id, conv_id AS trial_id, conv_id * 10 + turn % 2 AS player_id, substring('A;B;C;D;E;F', 1, CAST(2 * (conv_id % 6) + 1 AS INT)) AS option_set, substring('ABCDEF', CAST((conv_id + turn) % 6 AS INT) + 1, 1) AS choice
  FROM conversations
  WHERE role = 'assistant'""",
    "rounds_f": """SELECT user_id AS game_id, concat('p', CAST(user_id % 4 AS VARCHAR(20))) AS paper_id, target, CASE user_id % 4 WHEN 0 THEN 'thin' WHEN 1 THEN 'thick' WHEN 2 THEN 'network-swap' END AS structure, CAST(user_id % 3 * 2 + 2 AS INT) AS group_size, CAST(1 AS INT) AS stage_num, rep_num, CAST((rep_num - 1) * 12 + event_id % 12 + 1 AS INT) AS trial_num, event_id AS message_number, CASE WHEN user_id % 4 = 2 THEN user_id * 10 + event_id % 3 ELSE user_id * 10 END AS player_num, CASE WHEN user_id % 7 = 0 AND event_id % 5 = 0 THEN 'matcher' ELSE 'describer' END AS role, event_type AS text
  FROM (SELECT event_id, user_id, event_type, substring('ABCDEFGHIJKL', CAST(event_id % 12 AS INT) + 1, 1) AS target, CAST(floor((extract(day FROM ts) - 1) / (CASE WHEN user_id % 4 = 2 THEN 2.5 ELSE 5.0 END)) AS INT) + 1 AS rep_num
  FROM events) a""",
    "to_next_f": """SELECT user_id AS game_id, concat('p', CAST(user_id % 4 AS VARCHAR(20))) AS paper_id, target, CASE user_id % 4 WHEN 0 THEN 'thin' WHEN 1 THEN 'thick' WHEN 2 THEN 'network-swap' END AS structure, CAST(user_id % 3 * 2 + 2 AS INT) AS group_size, CAST(1 AS INT) AS stage_num, rep_num AS later, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100000 AS DOUBLE) AS sim
  FROM (SELECT user_id, value, substring('ABCDEFGHIJKL', CAST(event_id % 12 AS INT) + 1, 1) AS target, CAST(floor((extract(day FROM ts) - 1) / (CASE WHEN user_id % 4 = 2 THEN 2.5 ELSE 5.0 END)) AS INT) + 1 AS rep_num
  FROM events) a
  WHERE rep_num > 1
  GROUP BY user_id, target, rep_num""",
    "docs_f": """SELECT doc_id, concat('p', CAST(doc_id % 4 AS VARCHAR(20))) AS dataset_id, CAST(doc_id % 6 + 1 AS INT) AS rep_num, substring('ABCDEFGHIJKLMN', CAST(doc_id % 14 AS INT) + 1, 1) AS target, CASE WHEN doc_id % 3 = 0 THEN 'matcher' ELSE 'describer' END AS role, replace(replace(replace(replace(replace(replace(text, ' by ', ' maybe '), ' at ', ' looks like '), ' from ', ' unlikely '), ' with ', ' she '), ' for ', ' they '), ' as ', ' your ') AS text
  FROM documents""",
    "sets_f": """SELECT CAST(floor(vec_id / 16.0) AS BIGINT) AS set_id, CAST(vec_id % 16 AS INT) AS idx, CASE WHEN CAST(floor(vec_id / 16.0) AS BIGINT) % 2 = 0 THEN 'comp' ELSE 'noncomp' END AS set_type, embedding
  FROM embeddings""",
    "shapes_f": """SELECT p_partkey AS item_id
  FROM part""",
    "anchors_f": """SELECT * FROM (VALUES (1,'dim_a',0,true),(1,'dim_a',1,true),(2,'dim_b',2,false),(3,'dim_c',3,true),(3,'dim_c',4,true)) t(step,name,label,keep)""",
}

BUILDERS = {
    "conditions_f": conditions_f,
    "trials_f": trials_f,
    "messages_f": messages_f,
    "choices_f": choices_f,
    "rounds_f": rounds_f,
    "to_next_f": to_next_f,
    "docs_f": docs_f,
    "sets_f": sets_f,
    "shapes_f": shapes_f,
    "anchors_f": anchors_f,
}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs (in the order given)."""
    ctes = ",\n".join(f"{v} AS (\n{SQL[v]}\n)" for v in views)
    return f"WITH {ctes}\n{sql}"
