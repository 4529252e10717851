"""Per-message text features and their per-round summaries.

Per-message quantities are computed inside the row (array functions over the
token list), so no token-level shuffle is needed; per-round means are then one
``groupBy`` with map-side partial aggregation.  Token-level outputs (the token
table) explode and tag with the same expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoscope.functions import lexicon as lx
from convoscope.functions.text import phrase_count, sentences, tokens, with_first_token

Tagger = Callable[[Column], Column]


def describer_messages(
    messages: DataFrame,
    trials: DataFrame,
    keys=("dataset_id", "trial_id"),
    cols=("rep_num",),
    feature: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Describers' messages ⟕ trials[keys + cols].

    ``feature`` reduces the messages first (it must keep ``keys``), so that the
    join carries counts and flags instead of text."""
    m = messages.where(F.col("role") == "describer")
    if feature is not None:
        m = feature(m)
    return m.join(trials.select(*keys, *cols), list(keys), "left")


def with_hedges(df: DataFrame, phrases: Iterable[str] = lx.HEDGES, text: str = "text") -> DataFrame:
    """Add ``hedge_count``.  The lower-cased text is its own projection, so it
    is computed once and not inlined into every phrase count."""
    cols = df.columns
    low = df.select("*", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    return low.select(*cols, phrase_count("__low", phrases).alias("hedge_count"))


def mean_by(df: DataFrame, value: str, alias: str, keys=("rep_num",), digits: int = 6) -> DataFrame:
    """Mean of ``value`` per key; NULL keys are dropped (pandas groupby)."""
    k = list(keys)
    cond = None
    for c in k:
        cc = F.col(c).isNotNull()
        cond = cc if cond is None else cond & cc
    return df.where(cond).groupBy(*k).agg(F.round(F.avg(value), digits).alias(alias))


def hedge_by_rep(hedged: DataFrame, keys=("rep_num",)) -> DataFrame:
    """Mean ``hedge_count`` (see ``with_hedges``) per key."""
    return mean_by(hedged, "hedge_count", "hedge_count", keys)


# --- tagging ------------------------------------------------------------------

def default_tagger(tok: Column) -> Column:
    return lx.pos_of(tok)


def message_token_counts(df: DataFrame, keys, text: str = "text", tagger: Tagger = default_tagger) -> DataFrame:
    """Per message (``keys`` identify it): ``pronoun_count``, ``num_nominals``,
    ``num_non_nominals``.  Tokens are exploded and tagged with the codegen'd
    CASE expression; the per-message ``groupBy`` aggregates partially inside the
    task that produced the tokens (they are contiguous), so the shuffle carries
    one row per message, not one per token.  Messages without tokens count 0."""
    keys = list(keys)
    t = df.select(*keys, F.explode_outer(tokens(text)).alias("tok"))
    t = t.select(*keys, tagger(F.col("tok")).alias("pos"))
    pos = F.col("pos")
    nominal = lx.NOMINAL_POS
    return t.groupBy(*keys).agg(
        F.count_if(pos == "PRON").alias("pronoun_count"),
        F.count_if(pos.isin(nominal)).alias("num_nominals"),
        # every token of ``tokens`` is alphabetic, so is_alpha holds for all
        F.count_if(~pos.isin(nominal)).alias("num_non_nominals"),
    )


def token_table(docs: DataFrame, doc_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per token: doc id, 1-based sentence id, 1-based token id (restarting
    per sentence), lower-cased token."""
    s = docs.select(doc_col, F.posexplode(sentences(text)).alias("sentence_pos", "sentence"))
    t = s.select(
        doc_col,
        (F.col("sentence_pos") + 1).alias("sentence_id"),
        F.posexplode(tokens("sentence")).alias("token_pos", "token"),
    )
    return t.select(doc_col, "sentence_id", (F.col("token_pos") + 1).alias("token_id"), "token")


def tag_tokens(tokens_df: DataFrame, tagger: Tagger = default_tagger, token: str = "token") -> DataFrame:
    return tokens_df.withColumn("pos", tagger(F.col(token)))


# --- first word class ---------------------------------------------------------

def firstword_tags(describers: DataFrame, tagger: Tagger = default_tagger, text: str = "text") -> DataFrame:
    """Class flags of the first token of the first sentence.  Messages whose
    first sentence has no token keep NULL flags (the right join of the token
    table back onto all describer messages)."""
    cols = describers.columns
    d = with_first_token(describers, text, "__first")
    d = d.select("*", tagger(F.col("__first")).alias("__pos"))
    tok, pos = F.col("__first"), F.col("__pos")
    return d.select(
        *cols,
        (pos == "VERB").alias("V_first"),
        tok.isin(lx.DEFINITE_WORDS).alias("the_first"),
        tok.isin(lx.INDEFINITE_WORDS).alias("indef_first"),
        (pos.isin("NOUN", "ADJ") & (tok != lx.NOT_BARE_NOUN)).alias("bare_noun_first"),
    )


FLAGS = ["V_first", "the_first", "indef_first", "bare_noun_first"]


def firstword_audit(tagged: DataFrame) -> DataFrame:
    """Counts of messages with more than one class, with NULL flags, with none."""
    true_count = sum((F.col(f).cast("int") for f in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))
    return tagged.select(true_count.alias("tc")).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("tc") > 1).alias("n_multi"),
        F.count_if(F.col("tc").isNull()).alias("n_untagged"),
        F.count_if(F.col("tc") < 1).alias("n_none"),
    )


def firstword_long(tagged: DataFrame, ids=("doc_id", "rep_num")) -> DataFrame:
    """One row per true class flag.  Untagged messages have all flags NULL, so
    the ``value`` filter drops them too; no filter sits on the derived flags
    themselves (pushed below the projection it would inline the whole
    first-token and tagger chain)."""
    long = tagged.unpivot(list(ids), FLAGS, "first_type", "value")
    return long.where(F.col("value")).drop("value")


def firstword_counts(tagged: DataFrame) -> DataFrame:
    return firstword_long(tagged).groupBy("first_type").agg(F.count(F.lit(1)).alias("n"))


def firstword_props(tagged: DataFrame) -> DataFrame:
    # tagged messages only: count non-NULL flags in the aggregate (a filter on
    # the derived flag would be pushed into the projection chain)
    agg = tagged.groupBy("rep_num").agg(
        F.count(F.col("V_first")).alias("total_rows"),
        *[F.sum(F.col(f).cast("int")).cast("bigint").alias(f"{f}_true") for f in FLAGS],
    ).where(F.col("total_rows") > 0)
    kinds = {
        "proportion_v_first": "V_first_true",
        "proportion_the_first": "the_first_true",
        "proportion_indef_first": "indef_first_true",
        "proportion_barenoun_first": "bare_noun_first_true",
    }
    wide = agg.select(
        "rep_num",
        "total_rows",
        *[F.round(F.col(v) / F.col("total_rows"), 6).alias(k) for k, v in kinds.items()],
    )
    return wide.unpivot(["rep_num", "total_rows"], list(kinds), "kind", "proportion")


# --- pronouns, nominals, panel --------------------------------------------------

def pronoun_by_rep(counted: DataFrame) -> DataFrame:
    """Mean pronouns per message (``message_token_counts`` with rounds attached)."""
    return mean_by(counted, "pronoun_count", "avg_pronoun_count")


def nominal_messages(counted: DataFrame) -> DataFrame:
    f = counted.withColumn("total", F.col("num_nominals") + F.col("num_non_nominals")).where(F.col("total") > 0)
    return f.withColumn("prop_nominal", F.col("num_nominals") / F.col("total"))


def nominal_share(counted: DataFrame, digits: int | None = 6) -> DataFrame:
    f = nominal_messages(counted)
    if digits is None:
        return f.where(F.col("rep_num").isNotNull()).groupBy("rep_num").agg(F.avg("prop_nominal").alias("prop_nominal"))
    return mean_by(f, "prop_nominal", "prop_nominal", digits=digits)


def centred_rolling_mean(df: DataFrame, value: str, order: str, width: int = 3, alias: str = "rolling") -> DataFrame:
    """Centred rolling mean over ``width`` rows in ``order``; NULL where the
    window is incomplete (at the edges).  The input is one row per round, a
    small table, so a single ordered window is fine."""
    half = width // 2
    w = Window.orderBy(order).rowsBetween(-half, half)
    return df.select(
        "*",
        F.when(F.count(F.col(value)).over(w) == width, F.round(F.avg(value).over(w), 6)).alias(alias),
    )


def nominal_rolling(counted: DataFrame) -> DataFrame:
    """Rolling mean of the unrounded shares; both are rounded in the output only."""
    out = centred_rolling_mean(nominal_share(counted, digits=None), "prop_nominal", "rep_num")
    return out.withColumn("prop_nominal", F.round("prop_nominal", 6))


def panel_counts(messages: DataFrame, keys=("doc_id",), tagger: Tagger = default_tagger) -> DataFrame:
    """Per message: hedges beside the token counts."""
    h = with_hedges(messages.withColumn("text", F.coalesce("text", F.lit(""))))
    return message_token_counts(h, [*keys, "hedge_count"], tagger=tagger)


def feature_panel(f: DataFrame) -> DataFrame:
    """Three metrics per round: pronoun mean over all describer messages; the
    nominal proportion and the hedge mean over messages with at least one
    classified token.  One aggregation computes all three (conditional
    averages skip the other messages), then an unpivot makes the long panel.
    Input: ``panel_counts`` with rounds attached."""
    total = F.col("num_nominals") + F.col("num_non_nominals")
    nz = total > 0
    agg = f.where(F.col("rep_num").isNotNull()).groupBy("rep_num").agg(
        F.round(F.avg("pronoun_count"), 6).alias("Pronoun Count"),
        F.round(F.avg(F.when(nz, F.col("num_nominals") / total)), 6).alias("Nominal Proportion"),
        F.round(F.avg(F.when(nz, F.col("hedge_count"))), 6).alias("Hedge Count"),
    )
    long = agg.unpivot(["rep_num"], ["Pronoun Count", "Nominal Proportion", "Hedge Count"], "metric", "value")
    return long.where(F.col("value").isNotNull()).select("rep_num", "metric", "value")


def _category_map() -> Column:
    d = lx.pronoun_categories()
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def pronoun_tokens(describers: DataFrame, tagger: Tagger = default_tagger, keys=("doc_id",)) -> DataFrame:
    """Tokens kept for pronoun categories: tagged PRON or in the dictionary;
    category from the dictionary, default ``other``."""
    d = lx.pronoun_categories()
    t = describers.select(*keys, F.explode(tokens("text")).alias("token"))
    t = t.where((tagger(F.col("token")) == "PRON") | F.col("token").isin(list(d)))
    return t.withColumn("category", F.coalesce(F.try_element_at(_category_map(), F.col("token")), F.lit("other")))


def message_categories(messages: DataFrame, tagger: Tagger = default_tagger, keys=("doc_id",)) -> DataFrame:
    """Per message: ``categories``, its pronoun tokens by category as (category, count) pairs.
    Tokens are counted inside the task that splits the text; messages without any keep none."""
    counts = pronoun_tokens(messages, tagger, keys).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("count"))
    # at most one entry per category of the dictionary, and ``other``
    lists = counts.groupBy(*keys).agg(F.collect_list(F.struct("category", "count")).alias("categories"))
    return messages.select(*keys).join(lists, list(keys), "left")


def pronoun_categories(categorised: DataFrame) -> DataFrame:
    """Per (round, category): token count, describer messages of the round, and
    the rate per message (``message_categories`` with rounds attached).  Rounds
    with a NULL number drop out."""
    d = categorised.where(F.col("rep_num").isNotNull())
    t = d.select("rep_num", F.explode("categories").alias("c")).select("rep_num", "c.category", "c.count")
    counts = t.groupBy("rep_num", "category").agg(F.sum("count").alias("count"))
    n = d.groupBy("rep_num").agg(F.count(F.lit(1)).alias("n_messages"))
    j = counts.join(n, "rep_num")
    return j.withColumn("avg_count_per_msg", F.round(F.col("count") / F.col("n_messages"), 6))


def personal_pronouns(describers: DataFrame, tagger: Tagger = default_tagger) -> DataFrame:
    """Personal pronouns by frequency, the most frequent first."""
    t = pronoun_tokens(describers, tagger).where(F.col("category") == "personal")
    out = t.groupBy(F.col("token").alias("pronoun")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), "pronoun")


def message_genders(messages: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Per (message, category): gendered terms, counted inside the task that splits the text."""
    g = lx.gender_of()
    gmap = F.create_map(*[F.lit(x) for kv in g.items() for x in kv])
    t = messages.select(*keys, F.explode(tokens("text")).alias("token")).where(F.col("token").isin(list(g)))
    return t.groupBy(*keys, F.try_element_at(gmap, F.col("token")).alias("category")).agg(F.count(F.lit(1)).alias("count"))


def gender_by_target(gendered: DataFrame, targets=lx.TARGETS_A_L) -> DataFrame:
    """Gendered-term counts per (target, category) over targets A-L, with the
    full target x category grid (missing combinations count 0).  Input:
    ``message_genders`` with targets attached."""
    d = gendered.where(F.col("target").isin(list(targets)))
    counts = d.groupBy("target", "category").agg(F.sum("count").alias("count"))
    spark = gendered.sparkSession
    # the grid is parameter-sized (targets x 3 categories): a fixed literal
    grid = spark.createDataFrame(
        [(t_, c, ti + 1, ci + 1) for ti, t_ in enumerate(targets) for ci, c in enumerate(lx.GENDER_ORDER)],
        "target string, category string, target_ord int, category_ord int",
    )
    # counts are aggregated onto that same grid, so they are bounded by it too
    out = grid.join(F.broadcast(counts), ["target", "category"], "left")
    return out.select("target", "category", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "target_ord", "category_ord")


def tag_with_model(tokens_df: DataFrame, load_model, token: str = "token", out: str = "pos") -> DataFrame:
    """Plug in a trained tagger: ``load_model()`` returns a function from a
    list of tokens to a list of tags.  It runs once per task (the model is
    loaded on the executor, not shipped per row) over Arrow batches."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType(list(tokens_df.schema.fields) + [StructField(out, StringType(), True)])

    def run(batches):
        model = load_model()
        for pdf in batches:
            pdf[out] = model(pdf[token].tolist())
            yield pdf

    return tokens_df.mapInPandas(run, schema=schema)


def parse_with_model(docs: DataFrame, load_parser, doc_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Plug in a trained parser as a table function: doc_col, sentence_id, token_id, token, pos.

    ``load_parser()`` returns a function from a text to its sentences, each a list of (token, tag).  It
    runs once per task; texts reach it in Arrow batches, and a document gives any number of rows
    (the parser decides what a sentence and a token are).  Null texts give none."""

    class Parse:
        def __init__(self):
            self.parse = None

        def eval(self, value: str):
            if value is None:
                return
            if self.parse is None:
                self.parse = load_parser()
            for s, sentence in enumerate(self.parse(value), 1):
                for t, (token, pos) in enumerate(sentence, 1):
                    yield s, t, token, pos

    parsed = F.udtf(Parse, returnType="sentence_id int, token_id int, token string, pos string", useArrow=True)
    rows = docs.select(doc_col, F.col(text).cast("string").alias("__text"))
    return rows.lateralJoin(parsed(F.col("__text").outer())).select(doc_col, "sentence_id", "token_id", "token", "pos")
