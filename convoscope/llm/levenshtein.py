"""Levenshtein automaton of a whole lexicon: a trie walked with at most one edit, made deterministic.

A state of the product is a set of (trie node, edits so far).  ``compile_trie``
turns the product into one table, so that all words of a batch can run through
it in step; a word leaves as soon as its state is dead or decided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE, FUZZY, EXACT = 0, 1, 2
INNER = 2


@dataclass
class Automaton:
    classes: np.ndarray  # code point (up to 0xFFFF) -> letter class, 0: in no term
    step: np.ndarray  # state, class -> state; state 0 is dead
    inside: np.ndarray  # state: a term has been read in full, without edits, as the word's beginning
    whole: np.ndarray  # state: if the word ends here it is one edit from a term
    begun: np.ndarray  # state: the word's beginning is one edit, inside the term, from a term


def compile_trie(terms: list[str], fuzzy_from: int = 5) -> Automaton:
    """Terms match a word that begins with them.  Terms of ``fuzzy_from`` letters or more also match
    at one insertion, deletion or substitution: a whole word at any place, and the beginning of a
    longer word if the term's first and last letter are in place."""
    children: list[dict[str, int]] = [{}]
    final, loose, ahead = [False], [False], [False]
    for term in terms:
        node = 0
        for c in term:
            if len(term) >= fuzzy_from:
                ahead[node] = True
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                final.append(False)
                loose.append(False)
                ahead.append(False)
            node = children[node][c]
        final[node] = True
        if len(term) >= fuzzy_from:
            loose[node] = ahead[node] = True

    # (node, edits: 0, 1 or INNER for one behind the first letter, was the last letter in place after it?)
    Found = tuple[int, int, bool]
    edited = lambda node: INNER if node else 1

    def closure(found: set[Found]) -> frozenset[Found]:
        """Adds the states that skip one letter of a term."""
        more = {(k, edited(node), False) for node, e, _ in found if e == 0 for k in children[node].values() if ahead[k]}
        return frozenset(found | more)

    def follow(state: frozenset[Found], c: str | None) -> frozenset[Found]:
        out: set[Found] = set()
        for node, e, _ in state:
            if c in children[node]:
                to = children[node][c]
                out.add((to, e, e == INNER and loose[to]))
            if e == 0 and ahead[node]:
                out.add((node, edited(node), False))  # a letter too many
                out.update((k, edited(node), False) for k in children[node].values() if ahead[k])  # another letter
        return closure({(n, e, m) for n, e, m in out if e == 0 or ahead[n]})

    alphabet = sorted({c for t in terms for c in t if ord(c) < 0xFFFF})
    classes = np.zeros(0x10000, np.int32)
    for k, c in enumerate(alphabet):
        classes[ord(c)] = k + 1
    number = {frozenset(): 0, (start := closure({(0, 0, False)})): 1}
    table, todo = {0: [0] * (len(alphabet) + 1)}, [start]
    while todo:
        state = todo.pop()
        row = []
        for c in (None, *alphabet):
            to = follow(state, c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table[number[state]] = row
    order = sorted(number, key=number.get)
    return Automaton(
        classes,
        np.array([table[k] for k in range(len(number))], np.int32),
        np.array([any(final[n] and e == 0 for n, e, _ in s) for s in order]),
        np.array([any(loose[n] and e > 0 for n, e, _ in s) for s in order]),
        np.array([any(m for _, _, m in s) for s in order]),
    )


def match(machine: Automaton, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """NONE, FUZZY or EXACT for each word codes[start:end]."""
    out = np.zeros(len(starts), np.int8)
    if len(machine.step) < 2 or len(starts) == 0:
        return out
    alive = np.arange(len(starts))
    at, state = starts.copy(), np.ones(len(starts), np.int32)
    stop = ends
    while len(alive):
        state = machine.step[state, machine.classes[np.minimum(codes[at], 0xFFFF)]]
        at = at + 1
        exact = machine.inside[state]
        out[alive[machine.begun[state]]] = FUZZY
        out[alive[exact]] = EXACT
        over = at >= stop
        out[alive[over & ~exact & machine.whole[state]]] = FUZZY
        go = ~over & ~exact & (state != 0)
        alive, at, state, stop = alive[go], at[go], state[go], stop[go]
    return out
