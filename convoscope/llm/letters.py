"""Words of letters, and words disguised by digits and signs, in a list of texts, as code points in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

PIECE_CHARS = 1 << 20
#: Signs that stand for letters inside a word, and the letters that some of them look like (fixed values).
MASKING = "0123456789*@$!#%&+|^~_.-"
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}


@cache
def letter_table() -> np.ndarray:
    """True for the letters of the basic plane; the last entry stands for all other code points."""
    out = np.array([chr(i).isalpha() for i in range(0x10000)])
    out[0xFFFF] = False
    return out


@cache
def masking_table() -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[ord(c) for c in MASKING]] = True
    return out


@cache
def look_alike_table() -> np.ndarray:
    """Code point (up to 0xFFFF) -> the letter that it looks like, or itself."""
    out = np.arange(0x10000, dtype=np.uint32)
    for sign, letter in LOOK_ALIKE.items():
        out[ord(sign)] = ord(letter)
    return out


def lowered(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def pieces(texts: list[str], size: int = PIECE_CHARS) -> list[tuple[int, int]]:
    """Runs of texts of about ``size`` characters (a longer text stands alone)."""
    out, a, held = [], 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            out.append((a, k))
            a, held = k, 0
        held += len(t)
    if a < len(texts):
        out.append((a, len(texts)))
    return out


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts end to end, (start, end) of each run of letters in them,
    the index of each text's first run, and where each text begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    letter = letter_table()[np.minimum(codes, 0xFFFF)]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(codes))]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return codes, starts, ends, np.searchsorted(starts, offsets), offsets


def disguised_words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each run of letters and masking signs that begins and ends with a letter or a
    look-alike and has a sign in it, and the code points with look-alikes turned into letters.

    Texts end to end with ``offsets``, as ``letter_words`` gives them; runs of digits alone are left out.
    """
    small = np.minimum(codes, 0xFFFF)
    letter, sign = letter_table()[small], masking_table()[small]
    folded = look_alike_table()[small]
    folded = np.where(folded != small, folded, codes)
    edge = letter | (sign & (folded != codes))
    inner = offsets[(offsets > 0) & (offsets < len(codes))]
    cut = np.zeros(len(codes) + 1, bool)
    cut[inner] = True
    part = letter | sign
    first, last = part.copy(), part.copy()
    first[1:] &= ~part[:-1] | cut[1:-1]
    last[:-1] &= ~part[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    # trimmed to the first and last letter or look-alike; a run without letters, or of letters alone, goes
    at = np.flatnonzero(edge)
    if not len(at) or not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, folded
    has = np.searchsorted(at, ends) > np.searchsorted(at, starts)
    starts, ends = starts[has], ends[has]
    starts, ends = at[np.searchsorted(at, starts)], at[np.searchsorted(at, ends) - 1] + 1
    letters, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, sign))
    mixed = (letters[ends] > letters[starts]) & (signs[ends] > signs[starts])
    return starts[mixed], ends[mixed], folded
