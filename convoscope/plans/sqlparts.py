"""SQL fragments for the DuckDB oracle, rendered from the same fixed lists the
Spark code uses."""

from __future__ import annotations

from convoscope.functions import lexicon as lx


def hedge_sql(text: str, phrases=lx.HEDGES) -> str:
    t = f"lower(coalesce({text}, ''))"
    parts = [
        f"((length({t}) - length(replace({t}, '{p}', ''))) // {len(p)})" for p in sorted(set(phrases))
    ]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')"


def sentences_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[.!?\n]+\s*'), lambda x: x <> '')"


def first_token_sql(text: str) -> str:
    return f"nullif(regexp_extract(lower({sentences_sql(text)}[1]), '[a-z]+', 0), '')"


def in_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"


def fuzzy_sql(p: str, t: str) -> str:
    """Approximate containment, the same rule as ``functions.text.fuzzy_contains``
    but enumerated plainly: any window of length m-k..m+k within distance k."""
    m = f"length({p})"
    k = f"CAST(ceil(length({p}) * 0.1) AS INTEGER)"
    windows = (
        f"len(list_filter(range(1, greatest(length({t}), 1) + 1), lambda i: "
        f"len(list_filter(range(greatest({m} - {k}, 0), {m} + {k} + 1), "
        f"lambda ln: levenshtein({p}, substring({t}, i, ln)) <= {k})) > 0)) > 0"
    )
    return f"(CASE WHEN {p} IS NULL THEN NULL ELSE (contains({t}, {p}) OR {m} <= {k} OR {windows}) END)"
