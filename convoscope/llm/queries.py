"""opN_ queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoscope.llm import (
    decontaminate,
    langid_crf,
    lexical_search,
    mixing,
    mtree,
    product_codes,
    secret_ledger,
    site_style,
    toxicity,
    url_filter,
)
from convoscope.llm.minhash import near_duplicates
from convoscope.llm.suffix_dedup import remove_repeats
from convoscope.llm.substring_dedup import remove_repeated_windows
from convoscope.session import shared_path
from convoscope.sources.tables import table

SPAN_TOTAL = "aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)"


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.when(usable, F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)))
    return mtree.top_k(rows.select("vec_id", vector.alias("vector")), F.col("vec_id") % 100 == 0, k=10)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr(SPAN_TOTAL).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), cap=3)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid_crf.fit(docs.where(_remainder(4) != 2))
    out = langid_crf.predict(docs, model)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "shares")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    out = toxicity.toxicity(docs, model)
    return out.select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        "abuse",
        "quotation",
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = shared_path(spark, "llm", f"secret-ledger-{uuid.uuid4().hex}")  # a new ledger: every blob is unseen
    out = secret_ledger.scan(table(spark, sf_dir, "documents"), ledger)
    base = F.filter("found", lambda s: s.kind.isin(*secret_ledger.BASE))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *(count(k) for k in secret_ledger.BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", F.expr(SPAN_TOTAL).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    books = product_codes.train(rows, "embedding", "vec_id", scale=256, parts=16, entries=64, rounds=2)
    out = product_codes.encode(rows, books, "embedding", "vec_id", "label", scale=256)
    digest = F.lit(books.digest() if books else None).cast("string")
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_style.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_top_k": op1_mtree_top_k,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_product_codes": op11_product_codes,
    "op12_lexical_search": op12_lexical_search,
    "op13_site_style": op13_site_style,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mtree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
    "op3_source_mix": """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS own, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'),
           lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total, 3 * source_size AS most,
         coalesce(sum(3 * source_size) OVER w, 0) AS held,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS rest
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(CAST(total - held AS DOUBLE) / CAST(rest AS DOUBLE)) AS x FROM c),
t AS (
  SELECT source, source_size, documents, least(CAST(most AS DOUBLE), x * weight) AS target,
         CAST('0x' || substr(md5('mix|' || coalesce('=' || source, '')), 1, 6) AS BIGINT) AS off
  FROM c, level),
e AS (
  SELECT d.doc_id, d.source, d.size, d.own, t.source_size, t.target, t.off,
         CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 16777216) ELSE 0 END AS BIGINT) AS each,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), d.own)), 1, 6) AS BIGINT) % CAST(ceil(documents / 1000) AS BIGINT) AS block
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, off + CAST(sum(each) OVER (PARTITION BY source ORDER BY block, CASE WHEN block % 2 = 0 THEN size ELSE -size END, doc_id, own ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM e)
SELECT doc_id, size, source_size, target, ((stop >> 24) - ((stop - each) >> 24)) * size AS taken FROM p
""",
    "op6_decontamination": """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT * FROM (VALUES (0, [0, 1, 2, 3]), (1, [0, 1, 3, 5]), (2, [0, 2, 3, 6])) m(mask, pick)),
ds AS (
  SELECT doc_id, p, mask, concat_ws(' ', w[p + pick[1]], w[p + pick[2]], w[p + pick[3]], w[p + pick[4]]) AS seed
  FROM dw, unnest(generate_series(1, len(w))) AS g(p), m WHERE p + pick[4] <= len(w)),
si AS (
  SELECT item_id, p, mask, pick[4] + 1 AS span, concat_ws(' ', w[p + pick[1]], w[p + pick[2]], w[p + pick[3]], w[p + pick[4]]) AS seed
  FROM iw, unnest(generate_series(1, len(w))) AS g(p), m WHERE len(w) >= 4 AND p + pick[4] <= len(w)),
hits AS (SELECT doc_id, item_id, ds.p - si.p AS shift, si.p AS place, span FROM ds JOIN si USING (mask, seed)),
diag AS (
  SELECT doc_id, item_id, shift, least(13, len(iw.w)) AS compared,
         list_transform(range(1, len(iw.w) + 1),
           lambda j: CASE WHEN j + shift >= 1 AND dw.w[j + shift] = iw.w[j] THEN 1 ELSE 0 END) AS same
  FROM (SELECT DISTINCT doc_id, item_id, shift FROM hits) JOIN dw USING (doc_id) JOIN iw USING (item_id)),
win AS (
  SELECT doc_id, item_id, shift, compared, low, list_sum(list_slice(same, low, low + compared - 1)) AS matched
  FROM diag, unnest(generate_series(1, len(same) - compared + 1)) AS g(low)),
good AS (SELECT * FROM win WHERE matched >= greatest(ceil(compared * 80 / 100.0), least(compared, 7))),
inside AS (
  SELECT doc_id, item_id, count(*) AS hits FROM hits h
  WHERE EXISTS (SELECT 1 FROM good g WHERE g.doc_id = h.doc_id AND g.item_id = h.item_id AND g.shift = h.shift
                  AND g.low <= h.place AND h.place + h.span <= g.low + g.compared)
  GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(max(matched) AS INT) AS matched, CAST(max(compared) AS INT) AS compared, any_value(hits) AS hits
FROM good JOIN inside USING (doc_id, item_id) GROUP BY doc_id, item_id
""",
    "op7_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN list_aggregate(words, 'string_agg', ' ')
           ELSE list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') END AS h
  FROM w, unnest(generate_series(1, greatest(1, len(words) - 4))) AS g(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN low ON low.a = d.doc_id
""",
    "op10_substring_dedup": """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT r, i, list_aggregate(list_slice(words, i, i + 34), 'string_agg', ' ') AS s
  FROM w, unnest(generate_series(1, len(words) - 34)) AS g(i) WHERE len(words) >= 35),
rep AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS k FROM rep, unnest(generate_series(0, 34)) AS o(j)),
each AS (
  SELECT w.r, g.k, words[g.k] AS word, gone.k IS NOT NULL AS removed
  FROM w, unnest(generate_series(1, len(words))) AS g(k) LEFT JOIN gone ON gone.r = w.r AND gone.k = g.k),
sums AS (
  SELECT r, count(*) FILTER (WHERE removed) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT removed), '') AS kept
  FROM each GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN sums USING (r)
""",
    "op11_product_codes": """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < 64),
p AS (
  SELECT vec_id, label, part, list_slice(x, CAST(part * len(x) / 16 + 1 AS BIGINT), CAST((part + 1) * len(x) / 16 AS BIGINT)) AS y
  FROM v, range(16) AS r(part)),
c0 AS (
  SELECT part, entry, list_slice(x, CAST(part * len(x) / 16 + 1 AS BIGINT), CAST((part + 1) * len(x) / 16 AS BIGINT)) AS e
  FROM k, range(16) AS r(part)),
a0 AS (
  SELECT vec_id, label, part, any_value(y) AS y, min({'d': d, 'entry': entry}) AS near
  FROM (SELECT vec_id, label, part, y, entry,
               CAST(list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM p JOIN c0 USING (part))
  GROUP BY vec_id, label, part),
m0 AS (
  SELECT part, near.entry AS entry, i, CAST(floor(sum(y[i]) / count(*)) AS BIGINT) AS z
  FROM a0, unnest(range(1, len(y) + 1)) AS g(i) GROUP BY ALL),
c1 AS (
  SELECT c.part, c.entry, coalesce(n.e, c.e) AS e
  FROM c0 c LEFT JOIN (SELECT part, entry, list(z ORDER BY i) AS e FROM m0 GROUP BY ALL) n USING (part, entry)),
a1 AS (
  SELECT vec_id, label, part, any_value(y) AS y, min({'d': d, 'entry': entry}) AS near
  FROM (SELECT vec_id, label, part, y, entry,
               CAST(list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM p JOIN c1 USING (part))
  GROUP BY vec_id, label, part),
m1 AS (
  SELECT part, near.entry AS entry, i, CAST(floor(sum(y[i]) / count(*)) AS BIGINT) AS z
  FROM a1, unnest(range(1, len(y) + 1)) AS g(i) GROUP BY ALL),
c2 AS (
  SELECT c.part, c.entry, coalesce(n.e, c.e) AS e
  FROM c1 c LEFT JOIN (SELECT part, entry, list(z ORDER BY i) AS e FROM m1 GROUP BY ALL) n USING (part, entry)),
a2 AS (
  SELECT vec_id, label, part, any_value(y) AS y, min({'d': d, 'entry': entry}) AS near
  FROM (SELECT vec_id, label, part, y, entry,
               CAST(list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM p JOIN c2 USING (part))
  GROUP BY vec_id, label, part),
o AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(near.entry)), 2, '0'), '' ORDER BY part) AS code,
         CAST(sum(near.d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM o
""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS often
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
g AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
tf AS (
  SELECT doc_id, term, any_value(n) AS n, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
""",
}
