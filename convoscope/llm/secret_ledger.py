"""Secret scans with an incremental ledger of blobs.

Every version of every document is addressed by the SHA-256 of its text.  The
ledger, a Parquet table, holds one row per (blob, rule version) that was ever
scanned, with its findings.  A scan hashes all rows, leaves out what the ledger
has, reads the text of one holder of each blob that remains, appends the
findings, and joins the ledger's findings back to every row that holds the blob.
Running it again reads no text twice; an append that failed leaves nothing, so
the next run scans those blobs again.

Defined results: a null text is the empty blob; a null doc_id is a path like any
other; rows that repeat each get the findings; texts are scanned whole; no rows
give no rows; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoscope.llm.tables import stored

#: kind: (hint that any match contains once lower-cased, pattern, least length, group that is measured).  Fixed
#: values; the first three kinds are the base rules, in their order.
RULES: dict[str, tuple[tuple[str, ...], str, int, int]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    "access": (("akia",), r"AKIA[A-Z0-9]+", 18, 0),
    "hex": ((), r"[0-9a-f]{16,}", 16, 0),
    "private_key": (
        ("private key",),
        # through the matching end line, or without one to the end of the base64 block
        r"-----BEGIN (?P<of>[A-Z ]*)PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?P=of)PRIVATE KEY-----"
        r"|(?:(?:\s|\\[rn])*[A-Za-z][A-Za-z0-9-]*:\x20[^\n\\]*)*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{16,}={0,2})+"
        r"(?:(?:\s|\\[rn])+[A-Za-z0-9+/]{1,15}={0,2}(?=\x20*(?:[\r\n\"']|\\[rn]|\Z)))?)?",
        1,
        0,
    ),
    "jwt": (("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{30,}", 1, 0),
    "slack": (("xox",), r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    "url_login": (("://",), r"[a-z]{2,10}://[^\s/:@]*:[^\s/:@]+@", 1, 0),
}
KINDS = list(RULES)
BASE = KINDS[:3]
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
FOUND = "array<struct<begin:long,end:long,kind:string>>"
SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_COMPILED = {kind: re.compile(pattern) for kind, (_, pattern, _, _) in RULES.items()}


def find(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of all matches, by begin, then by the kinds' order; code points, end exclusive."""
    low = text.lower()
    out = []
    for order, (kind, (hints, _, least, group)) in enumerate(RULES.items()):
        if hints and not any(h in low for h in hints):
            continue
        for m in _COMPILED[kind].finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The findings so far (blob, rules, found), or None before the first scan."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def findings(spark: SparkSession, path: str) -> DataFrame:
    """(blob, found) of the blobs with findings under these rules."""
    return spark.read.parquet(path).where((F.col("rules") == VERSION) & (F.size("found") > 0)).select("blob", "found")


def _holders(docs: DataFrame) -> DataFrame:
    """Rows with their blob and a key that spreads rows without an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("blob"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("holder"),
        text.alias("text"),
    )


def _scanned(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"begin": a, "end": b, "kind": k} for a, b, k in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, SPAN)], ["blob", "found"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob binary, found {FOUND}")


def scan(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, blob (hex), found; one row per input row.

    Appends to the ledger at ``path`` what it didn't hold under these rules.
    """
    spark = docs.sparkSession
    rows = _holders(docs)
    paths = stored(rows.drop("text"), "blobs")
    wanted = paths.groupBy("blob").agg(F.min("holder").alias("holder"))
    before = ledger(spark, path)
    if before is not None:
        wanted = wanted.join(before.where(F.col("rules") == VERSION), "blob", "left_anti")
    # joined on the holder, so that a blob with very many holders is read once, not gathered
    # (both sides grow with the corpus: merged, never broadcast)
    new = _scanned(rows.join(wanted.hint("merge"), ["holder", "blob"], "left_semi"))
    # rows that repeat under one id can bring a blob twice
    new.dropDuplicates(["blob"]).withColumn("rules", F.lit(VERSION)).write.mode("append").parquet(path)
    out = paths.join(findings(spark, path), "blob", "left")
    return out.select(
        "doc_id",
        F.lower(F.hex("blob")).alias("blob"),
        F.coalesce("found", F.array().cast(FOUND)).alias("found"),
    )


def redacted(docs: DataFrame, path: str, mask: str = "[secret]") -> DataFrame:
    """docs with every finding in ``text`` replaced by ``mask`` and ``n_chars`` brought up to date.

    Findings come from the ledger by blob; rows without one pass unchanged.
    """
    spark = docs.sparkSession
    scan(docs.select("doc_id", "text"), path)
    known = findings(spark, path)
    name = "_found"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    schema = docs.schema
    text_at = schema.fieldNames().index("text")
    keyed = docs.withColumn(f"{name}_blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    known = known.select(F.col("blob").alias(f"{name}_blob"), F.col("found").alias(name))
    joined = keyed.join(known.hint("merge"), f"{name}_blob", "left").drop(f"{name}_blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(name).to_pylist()
            kept = batch.drop_columns([name])
            if any(found):
                texts = batch.column("text").to_pylist()
                changed = {k: masked(texts[k], [(s["begin"], s["end"]) for s in f], mask) for k, f in enumerate(found) if f}
                texts = [changed.get(k, t) for k, t in enumerate(texts)]
                kept = kept.set_column(text_at, kept.schema.field(text_at), pa.array(texts, kept.schema.field(text_at).type))
                if "n_chars" in kept.schema.names:
                    at = kept.schema.get_field_index("n_chars")
                    n = [len(changed[k]) if k in changed else v for k, v in enumerate(kept.column(at).to_pylist())]
                    kept = kept.set_column(at, kept.schema.field(at), pa.array(n, kept.schema.field(at).type))
            yield kept

    return joined.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
