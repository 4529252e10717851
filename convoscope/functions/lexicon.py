"""Word lists and the default part-of-speech tagger.

The tagger is a closed-class lexicon plus ordered suffix rules, written as one
CASE expression over ``IN`` lists (Catalyst turns long ``IN`` lists into hash
sets), so it runs inside codegen and repeats verbatim in DuckDB.  Its tags are
defined by these lists; they will not equal those of a trained tagger.  A
different tagger can be plugged in through ``operators.features.tag_tokens``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the word lists of the analyses being reproduced.
# Hedge phrases, counted as plain substrings of the lower-cased text.
HEDGES = [
    "maybe", "perhaps", "probably", "possibly", "seems", "i think", "i guess",
    "sort of", "kind of", "somewhat", "a little", "not sure", "might", "could",
    "likely", "appears", "looks like", "i feel like", "i suppose",
]
# The frequency variant adds one phrase.
HEDGES_FREQUENCY = HEDGES + ["kinda"]

# Pronoun categories, in their natural order; a word listed twice takes its
# last category ("her" -> possessive, "that" -> relative).  "no one" has a
# space and can never equal a single token.
PRONOUN_CATEGORY_PAIRS = [
    ("i", "personal"), ("you", "personal"), ("he", "personal"), ("she", "personal"), ("it", "personal"),
    ("we", "personal"), ("they", "personal"), ("me", "personal"), ("him", "personal"), ("her", "personal"),
    ("us", "personal"), ("them", "personal"),
    ("my", "possessive"), ("your", "possessive"), ("his", "possessive"), ("her", "possessive"),
    ("its", "possessive"), ("our", "possessive"), ("their", "possessive"),
    ("this", "demonstrative"), ("that", "demonstrative"), ("these", "demonstrative"), ("those", "demonstrative"),
    ("myself", "reflexive"), ("yourself", "reflexive"), ("himself", "reflexive"), ("herself", "reflexive"),
    ("itself", "reflexive"), ("ourselves", "reflexive"), ("themselves", "reflexive"),
    ("someone", "indefinite"), ("anyone", "indefinite"), ("everyone", "indefinite"), ("no one", "indefinite"),
    ("something", "indefinite"), ("anything", "indefinite"), ("nothing", "indefinite"), ("everything", "indefinite"),
    ("who", "relative"), ("whom", "relative"), ("which", "relative"), ("that", "relative"),
]
PRONOUN_CATEGORY_ORDER = ["personal", "possessive", "demonstrative", "reflexive", "indefinite", "relative", "other"]

# Gendered terms by category.
GENDER_TERMS = {
    "male": ["man", "men", "boy", "boys", "he", "his", "him", "guy", "gentleman", "gentlemen"],
    "female": ["woman", "women", "girl", "girls", "she", "her", "hers", "lady", "ladies"],
    "neutral": ["person", "people", "child", "children", "individual", "thing", "it", "they", "them", "their"],
}
GENDER_ORDER = ["male", "female", "neutral"]
# Targets kept by the per-target analyses.
TARGETS_A_L = list("ABCDEFGHIJKL")
# Structure levels, in their order; anything else (and NULL) is no level.
STRUCTURE_LEVELS = ["thin", "medium", "med_thick", "thick", "network-swap", "naive-swap"]
# First-word classes.
DEFINITE_WORDS = ["the"]
INDEFINITE_WORDS = ["a", "an"]
NOT_BARE_NOUN = "sorry"
# Part-of-speech classes that count as nominal.
NOMINAL_POS = ["NOUN", "PROPN", "PRON"]
# ---------------------------------------------------------------------------


def pronoun_categories() -> dict[str, str]:
    """The pronoun dictionary with last-wins semantics for repeated words."""
    return dict(PRONOUN_CATEGORY_PAIRS)


def gender_of() -> dict[str, str]:
    return {w: cat for cat, words in GENDER_TERMS.items() for w in words}


# Default tagger lexicon (closed classes).  Every word is in one class.
TAGGER_LEXICON = {
    "PRON": (
        "i you he she it we they me him her us them my your his its our their mine yours hers ours theirs "
        "myself yourself himself herself itself ourselves themselves someone anyone everyone something "
        "anything nothing everything somebody anybody everybody nobody who whom whose what"
    ).split(),
    "DET": "the a an this that these those each every some any no another either neither all both which".split(),
    "ADP": (
        "of in on at by for with from to into onto over under above below between behind beside near like "
        "through across around along against toward towards about upon within without"
    ).split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because while although though since unless whereas whether".split(),
    "AUX": (
        "is are was were be been being am do does did have has had will would can could shall should may "
        "might must"
    ).split(),
    "PART": "not s t".split(),
    "ADV": (
        "very too also just only really then there here now still again maybe perhaps probably possibly "
        "almost quite somewhat rather so kinda"
    ).split(),
    "INTJ": "yes yeah ok okay oh um uh hmm hi hello thanks".split(),
    "NUM": "one two three four five six seven eight nine ten".split(),
    "VERB": "click choose pick select find look see go take move get put make say think guess seems appears".split(),
    "ADJ": "small big large little left right top bottom tall short long wide thin thick upper lower other same sorry".split(),
}
# Ordered suffix rules for words outside the lexicon; the default is NOUN.
SUFFIX_RULES = [
    ("ly", "ADV"),
    ("ing", "VERB"),
    ("ed", "VERB"),
    ("ous", "ADJ"),
    ("ful", "ADJ"),
    ("able", "ADJ"),
    ("ible", "ADJ"),
    ("ive", "ADJ"),
    ("less", "ADJ"),
    ("ish", "ADJ"),
    ("ic", "ADJ"),
    ("al", "ADJ"),
]


def _check_lexicon() -> None:
    seen: dict[str, str] = {}
    for pos, words in TAGGER_LEXICON.items():
        for w in words:
            if w in seen:
                raise AssertionError(f"{w!r} in both {seen[w]} and {pos}")
            seen[w] = pos


_check_lexicon()


def pos_of(token: Column) -> Column:
    """Part-of-speech tag of a lower-case alphabetic token."""
    expr = None
    for pos, words in TAGGER_LEXICON.items():
        cond = token.isin(words)
        expr = F.when(cond, pos) if expr is None else expr.when(cond, pos)
    for suffix, pos in SUFFIX_RULES:
        expr = expr.when(token.endswith(suffix), pos)
    return F.when(token.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise("NOUN"))


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pos_sql(token: str) -> str:
    """The same tagger as SQL text (for the DuckDB oracle)."""
    parts = [f"WHEN {token} IN ({_sql_list(words)}) THEN '{pos}'" for pos, words in TAGGER_LEXICON.items()]
    parts += [f"WHEN suffix({token}, '{s}') THEN '{pos}'" for s, pos in SUFFIX_RULES]
    return f"CASE WHEN {token} IS NULL THEN NULL " + " ".join(parts) + " ELSE 'NOUN' END"


def values_sql(rows, columns) -> str:
    """A VALUES table literal."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({','.join(columns)}))"
