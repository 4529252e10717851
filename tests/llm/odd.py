"""Rows that operators must stand: nulls, empty and long texts, ties, copies, clashing columns."""

import random

LANGS = {
    "en": "the of and that with this have from they would there what about which when make time people over house",
    "de": "der die und nicht sich mit auch werden einer haben noch wurde zwischen schon immer gegen während straße",
    "fr": "les des est que dans pour une avec sont cette mais nous vous leurs être avoir depuis toujours écrire",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch long, key string, score double, found int, copies int, size string"


def prose(rng, n, lang="en"):
    words = LANGS[lang].split()
    return " ".join("".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2]))) for _ in range(n))


def odd_rows(seed=5):
    rng = random.Random(seed)
    base = [prose(rng, 120, rng.choice(list(LANGS))) for _ in range(25)]
    texts = [(k * 3, t) for k, t in enumerate(base)]
    texts += [(200 + k, base[k]) for k in range(5)]  # exact copies
    for k in range(6):  # near copies
        w = base[k].split()
        w[k * 7 + 3] = "changed"
        texts.append((300 + k, " ".join(w)))
    shared = prose(rng, 60)
    texts += [(400 + k, f"{prose(rng, 30)} {shared}\n{prose(rng, 20)}") for k in range(4)]
    texts += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "one two three"), (505, "one two three")]
    texts += [(506, "été Ünïcode ñ 漢字 " * 12), (507, "a" * 300), (508, "ab" * 200), (509, "=" * 90 + "\n" + "=" * 90)]
    texts += [(510, prose(rng, 6000)), (511, "x y " * 100)]
    texts += [(None, base[7]), (None, None), (None, base[8] + " more"), (0, base[0]), (0, base[0]), (600, "TOKEN one Two THREE " * 9)]
    rng.shuffle(texts)
    sources = ["a", "b", None, "ä", "Z"]
    return [
        (i, t, rng.choice([*LANGS, None]), sources[k % 5] if k % 3 else "a", len(t or ""), 1, "k", 0.5, 2, 3, "s")
        for k, (i, t) in enumerate(texts)
    ]


def odd_docs(spark, seed=5):
    return spark.createDataFrame(odd_rows(seed), SCHEMA).repartition(3)
