"""Suffix arrays in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of integers, by refinement of groups with doubled depth.

    Suffixes are grouped by their first symbols, as many of them as one word holds; each round orders the members
    of groups not yet single by the group of what follows ``depth`` symbols later, and doubles the depth. Sorted
    suffixes are never touched again. The end of the sequence is smaller than any symbol; symbols are not negative.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = int(symbols.max() + 1).bit_length()
    depth = max(1, min(4, 62 // bits))
    padded = np.concatenate([symbols + 1, np.zeros(depth, np.int64)])
    first = np.zeros(n, np.int64)
    for k in range(depth):
        first = (first << bits) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    ranks = np.empty(n + 1, np.int64)
    ranks[n] = -1
    new = np.concatenate(([True], first[order[1:]] != first[order[:-1]]))
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks[order] = heads
    single = new & np.append(new[1:], True)
    open_places = np.flatnonzero(~single)
    while len(open_places):
        members = order[open_places]
        group = ranks[members]
        after = ranks[np.minimum(members + depth, n)]
        resort = np.argsort(group * (n + 1) + after + 1, kind="stable")
        members, group, after = members[resort], group[resort], after[resort]
        order[open_places] = members
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        heads = np.maximum.accumulate(np.where(new, np.arange(len(members)), 0))
        ranks[members] = open_places[heads]
        open_places = open_places[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, ranks[:n]


def common_prefixes(symbols: np.ndarray, order: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it (0 for the first).

    Kasai's rule in text order: where a suffix and its predecessor in the array are preceded by equal symbols,
    its common prefix is one less than that of the suffix one place to the left. The other suffixes are
    compared symbol by symbol, all at once; their lengths sum to n log n at most.
    """
    n = len(symbols)
    lengths = np.zeros(n, np.int64)
    if n < 2:
        return lengths
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = symbols[at[follows] - 1] == symbols[before[follows] - 1]
    heads = np.flatnonzero(~follows)
    active = heads[before[heads] >= 0]
    step = np.zeros(n, np.int64)
    while len(active):
        a, b = active + step[active], before[active] + step[active]
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[symbols[a] == symbols[b]]
        step[active] += 1
    head_of = np.maximum.accumulate(np.where(follows, 0, at))
    lengths = np.maximum(step[head_of] - (at - head_of), 0)
    return lengths[order]
