"""String column functions. All are built-in expressions: they stay in the JVM
and inside whole-stage codegen (the lambda-based ones are interpreted but still
JVM-side); no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """Lower-case, delete every character outside ``[a-z ]``, squeeze runs of
    spaces, trim.  NULL stays NULL.  ``"Don't\\nGO  left-ish!"`` -> ``"dontgo leftish"``."""
    t = F.regexp_replace(F.lower(_c(text)), r"[^a-z ]", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def count_literal(text, phrase: str) -> Column:
    """Non-overlapping occurrences of ``phrase`` in ``text`` (no word boundaries,
    like Python's ``str.count``).  NULL text gives NULL."""
    t = _c(text)
    n = len(phrase)
    # byte-level search first; the replace (a copy of the text) only runs for
    # texts that contain the phrase
    cnt = ((F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / F.lit(n)).cast("bigint")
    return F.when(t.isNull(), F.lit(None).cast("bigint")).when(F.contains(t, F.lit(phrase)), cnt).otherwise(F.lit(0).cast("bigint"))


def phrase_count(text, phrases: Iterable[str]) -> Column:
    """Sum of ``count_literal`` over a phrase list, on the lower-cased text;
    missing text counts 0."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    total = None
    for p in sorted(set(phrases)):
        c = count_literal(t, p)
        total = c if total is None else total + c
    return total if total is not None else F.lit(0).cast("bigint")


def word_count(text) -> Column:
    """Number of parts when splitting on a single space (``""`` -> 1, double
    spaces add an empty part), NULL for NULL."""
    return F.size(F.split(_c(text), " ")).cast("bigint")


def tokens(text) -> Column:
    """Alphabetic tokens of the lower-cased text, as ``array<string>``."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]+"), 0)


def sentences(text) -> Column:
    """Non-empty sentences: split after runs of ``.``, ``!``, ``?`` or newline."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"[.!?\n]+\s*")
    return F.filter(parts, lambda s: s != "")


SENTENCE_DELIMS = ".!?\n"
WHITESPACE = " \t\n\x0b\f\r"


def with_first_token(df, text: str = "text", alias: str = "first_token"):
    """Add the first alphabetic token of the first non-empty sentence
    (lower-cased; NULL when that sentence has none) -- the same as taking
    element 1 of ``sentences`` -- in time proportional to that sentence and
    without regex over the whole text: a text opening with a delimiter run
    (delimiters and the whitespace after them) has it trimmed, then it is cut
    at the first delimiter.  ``ltrim``/``instr``/``substring`` work on the
    UTF-8 bytes (a Java regex would first copy the whole text to a Java
    string).  Staged projections keep each intermediate computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.substring(t, 1, 1).isin(list(SENTENCE_DELIMS))
    s1 = df.select("*", F.when(starts, F.ltrim(t, F.lit(SENTENCE_DELIMS + WHITESPACE))).otherwise(t).alias("__skip"))
    hits = [F.instr(F.col("__skip"), d) for d in SENTENCE_DELIMS]
    s2 = s1.select("*", F.least(*[F.when(h > 0, h) for h in hits]).alias("__cut"))
    first = F.when(F.col("__cut").isNull(), F.col("__skip")).otherwise(F.substring(F.col("__skip"), F.lit(1), F.col("__cut") - 1))
    s3 = s2.select("*", F.regexp_extract(F.lower(first), "[a-z]+", 0).alias("__tok"))
    return s3.select("*", F.when(F.col("__tok") != "", F.col("__tok")).alias(alias)).drop("__skip", "__cut", "__tok")


def fuzzy_k(pattern) -> Column:
    """Edit budget of approximate matching: ceil(0.1 * len(pattern))."""
    return F.ceil(F.length(_c(pattern)) * F.lit(0.1)).cast("int")


def _occurrences(text: Column, piece: Column) -> Column:
    """0-based positions of a piece in the text, overlapping ones too: the text is cut before each
    occurrence (a look-ahead takes no characters) and the lengths are summed."""
    literal = F.regexp_replace(piece, "([^A-Za-z0-9 ])", r"\\$1")
    cuts = F.split(text, F.concat(F.lit("(?=("), literal, F.lit("))")), -1)
    # a cut yields no empty part in front, so the first part begins with the piece if the text does
    lengths = F.transform(cuts, F.length)
    starts = F.aggregate(
        lengths,
        F.array(F.lit(0)),
        lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)),
    )
    inner = F.slice(starts, 2, F.greatest(F.size(starts) - 2, F.lit(0)))
    return F.when(F.startswith(text, piece), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(1)))).otherwise(inner)


def _nearest(pattern: Column, k: Column, candidates: Column) -> Column:
    """The least edit distance of the pattern to one of the candidates, NULL if all are above k."""
    distance = F.transform(candidates, lambda c: F.call_function("levenshtein", pattern, c, k))
    return F.array_min(F.filter(distance, lambda d: d >= 0))


def fuzzy_contains(pattern, text) -> Column:
    """True when some substring of ``text`` is within Levenshtein distance
    k = ceil(0.1 * len(pattern)) of ``pattern`` (approximate containment, all
    edit costs 1).  NULL patterns give NULL, NULL texts count as empty.

    Exact containment, and a pattern no longer than k (the empty substring
    matches), are told first.  Else the pattern is cut into k + 1 pieces: k edits
    leave one of them whole, so every match holds a piece verbatim, and only the
    places where a piece occurs are looked at.  There the match splits: what stands
    before the piece must be near some end of the text before it, what follows near
    some beginning of the text behind it, and both distances together are at most k.
    A place costs about 4k banded ``levenshtein`` calls, however long the text is.
    """
    p, t = _c(pattern), F.coalesce(_c(text), F.lit(""))
    m = F.length(p)
    k = fuzzy_k(p)

    def begin(j):
        return F.floor(j * m / (k + 1)).cast("int")

    def at_piece(j):
        length = begin(j + 1) - begin(j)
        piece = F.substring(p, begin(j) + 1, length)
        head, tail = F.substring(p, F.lit(1), begin(j)), F.substring(p, begin(j + 1) + 1, m)

        def matches(at):
            reach = begin(j) + k  # no more of the text in front can take part
            front = F.substring(t, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, reach))
            back = F.substring(t, at + length + 1, m - begin(j + 1) + k)
            # the shortest and longest texts that can be within k edits; none, if too few characters are left
            ends = lambda part, near: F.when(
                F.length(part) >= F.length(near) - k,
                F.sequence(F.greatest(F.length(near) - k, F.lit(0)), F.least(F.length(near) + k, F.length(part))),
            ).otherwise(F.array().cast("array<int>"))
            before = F.transform(ends(front, head), lambda n: F.substring(front, F.length(front) - n + 1, n))
            after = F.transform(ends(back, tail), lambda n: F.substring(back, F.lit(1), n))
            return F.exists(
                F.array(_nearest(head, k, before)),
                lambda d: F.when(d.isNull(), False).otherwise(F.coalesce(d + _nearest(tail, k, after) <= k, F.lit(False))),
            )

        return F.when(F.contains(t, piece), F.exists(_occurrences(t, piece), matches)).otherwise(F.lit(False))

    seeds = F.exists(F.sequence(F.lit(0), k), at_piece)
    found = F.when(F.contains(t, p) | (m <= k), F.lit(True)).otherwise(seeds)
    return F.when(p.isNotNull(), found)
