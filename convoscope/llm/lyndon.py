"""Suffix arrays of many short texts at once, by linear grouping construction.

A suffix is grouped by its Lyndon prefix, the longest Lyndon word it begins
with.  Phase one starts from groups by first letter and takes each text's
highest unfinished group: every suffix in it points to its previous smaller
suffix, the nearest one to the left that lies in a lower group; suffixes pointed
to extend their prefix by the group's word, once per pointer, and so move up
behind the rest of their group, those with more repeats further.  Phase two
walks the suffixes in ascending order and places each one's left neighbours
along the previous-smaller pointers at the front of their groups.  No suffix is
ever renamed or compared letter by letter.

Texts are lanes: each round does one group of every lane in the same array
operations, and each step of phase two one suffix of every lane.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(first - start, size)


def _leads(*cols: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins."""
    out = np.ones(len(cols[0]), bool)
    for c in cols:
        if c is cols[0]:
            out[1:] = c[1:] != c[:-1]
        else:
            out[1:] |= c[1:] != c[:-1]
    return out


def group(codes: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one.  Lane k is codes[low[k]+1 : low[k]+1+size[k]]; codes[low[k]] stands before
    it and is lower than everything.  A lane's last code is its lowest and occurs once.

    Returns each suffix's group (the first place of that group in ascending order) and
    its pointer to the previous smaller suffix.
    """
    n = len(codes)
    lane = np.zeros(n, np.int64)
    lane[low] = 1
    lane = np.cumsum(lane) - 1
    rank = codes.astype(np.int64) + 1
    rank[low] = 0
    order = np.argsort(lane * (int(rank.max(initial=0)) + 1) + rank, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    first = np.flatnonzero(_leads(lane[order], rank[order]))
    members = np.diff(np.append(first, n))
    of = np.empty(n, np.int32)
    of[order] = np.repeat(first, members)
    of[low] = -1
    count = np.zeros(n + 1, np.int32)
    count[first] = members
    before = np.arange(-1, n - 1, dtype=np.int32)
    moving = np.zeros(n, bool)
    floor, top = low + 1, low + 1 + size
    while len(top):
        start = of[order[top - 1]]
        width = top - start
        here = order[_ranges(start, width)]
        mine = np.repeat(start, width)
        p = before[here]
        wait = np.flatnonzero(of[p] >= mine)
        while len(wait):
            p[wait] = before[p[wait]]
            wait = wait[of[p[wait]] >= mine[wait]]
        before[here] = p
        p = np.sort(p[of[p] >= 0])
        if len(p):
            lead = np.flatnonzero(_leads(p))
            up, times = p[lead], np.diff(np.append(lead, len(p)))
            home = of[up]
            by = np.argsort((home.astype(np.int64) << 32) | times)
            up, times, home = up[by], times[by], home[by]
            h = np.flatnonzero(_leads(home))
            k = np.diff(np.append(h, len(home)))
            tail = np.repeat(home[h] + count[home[h]] - k, k)
            target = tail + np.arange(len(up)) - np.repeat(h, k)
            lead = np.flatnonzero(_leads(home, times))
            width = np.diff(np.append(lead, len(up)))
            count[home[h]] -= k
            count[target[lead]] = width
            of[up] = np.repeat(target[lead], width)
            # the group's other suffixes leave its tail for the places that become free
            moving[up] = True
            away = order[target]
            away = away[~moving[away]]
            free = place[up]
            free = free[free < tail]
            order[free], place[away] = away, free
            order[target], place[up] = up, target
            moving[up] = False
        go = start > floor
        top, floor = start[go], floor[go]
    return of, before


def emit(of: np.ndarray, before: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Phase two: each lane's suffixes in ascending order, in its places low+1 ... low+size."""
    n = len(of)
    out = np.zeros(n, np.int32)
    front = np.arange(n, dtype=np.int32)
    placed = np.zeros(n, bool)
    placed[low] = True
    by = np.argsort(-size, kind="stable")
    low, size = low[by], size[by]
    out[low + 1] = low + size
    placed[low + size] = True
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for t, m in enumerate(active.tolist()):
        j = out[low[:m] + 1 + t] - 1
        j = j[~placed[j]]
        while len(j):
            g = of[j]
            at = front[g]
            out[at] = j
            front[g] = at + 1
            placed[j] = True
            j = before[j]
            j = j[~placed[j]]
    return out


def suffix_order(codes: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    of, before = group(codes, low, size)
    return emit(of, before, low, size)
