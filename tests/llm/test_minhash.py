"""MinHash components against all pairs, list merging by blocks, and defined cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_duplicates import TEXTS, corpus, frame

from scholium.llm import minhash as m


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        own = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), own, d == own))
    return sorted(map(str, out))


def shown(df):
    return sorted(str(tuple(r)[:4]) for r in df.collect())


def near_copies(seed, n, words, edits):
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rnd.sample(range(words), rnd.randrange(edits)):
            copy[at] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, m.LIST), (2, 3)])
def test_components(spark, seed, limit):
    """Copies with up to so many edits lie on both sides of the threshold, with and without a common base."""
    texts = [*TEXTS, *corpus(seed), *near_copies(seed, 60, 60, 8), *near_copies(seed + 9, 25, 200, 30), "x y z u v", "x y z u v w"]
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    assert shown(m.near_duplicates(frame(spark, texts, ids), limit=limit)) == plain(rows)


def test_defined_cases(spark):
    long = " ".join(f"w{i % 700} v{i % 501}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (4, "A b c  d e f"), (5, "a b c d e f"), (5, "other words of it"), (None, "alone here"), (None, None), (8, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (12, long), (13, long + " end")]
    df = spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], "doc_id long, text string, n int, token string, component_id int, t string")
    got = m.near_duplicates(df)
    assert shown(got) == plain(rows)
    assert m.near_duplicates(df.limit(0)).count() == 0
    assert m.near_duplicates(df.filter("text is null")).count() == 2


def members_of_a_list(seed, n=300):
    """Sets around a few bases, from near to far, with their signatures and components."""
    rnd = np.random.default_rng(seed)
    bases = [rnd.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(7)]
    sets = []
    for _ in range(n):
        base = bases[rnd.integers(7)]
        kept = base[rnd.random(100) > rnd.random() * 0.25]
        sets.append(np.unique(np.concatenate([kept, rnd.integers(0, 1 << 63, rnd.integers(0, 20), dtype=np.uint64)])))
    signs = np.array([np.frombuffer(m.short_digests(m.signature(x)), np.uint16) for x in sets])
    return np.arange(n), rnd.integers(0, 200, n), np.array([len(x) for x in sets]), signs, sets


def test_pairs_of_a_short_list():
    names, _, sizes, signs, _ = members_of_a_list(1, 80)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if (signs[i] == signs[j]).sum() >= 32 and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])}
    u, v = m.list_pairs(names, sizes, signs, 32, 80)
    assert set(zip(u.tolist(), v.tolist())) == want and want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_a_long_list(seed):
    """They join the components that all pairs join, each a true link, and are fewer than members."""
    names, component, sizes, signs, sets = members_of_a_list(seed)

    def joined(links):
        label = component.copy()
        for i, j in links:
            label[label == label[j]] = label[i]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())}

    alike = lambda i, j: 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 80 * len(set(sets[i].tolist()) | set(sets[j].tolist()))
    every = [(i, j) for i in range(300) for j in range(i) if alike(i, j)]
    u, v = m.list_links(names, component, sizes, signs, sets, 32, 80)
    assert joined(zip(u.tolist(), v.tolist())) == joined(every) and 0 < len(u) < 300 < len(every)
    assert all(alike(i, j) for i, j in zip(u.tolist(), v.tolist()))


def test_collisions_follow_the_similarity():
    """At a similarity of 0.8 pairs have some 51 collisions of 64 and hardly ever under 32."""
    rnd = random.Random(2)
    counts = []
    for _ in range(300):
        common = [rnd.getrandbits(64) for _ in range(80)]
        a, b = ([*common, *(rnd.getrandbits(64) for _ in range(10))] for _ in range(2))
        counts.append(int((m.signature(np.array(a, np.uint64)) == m.signature(np.array(b, np.uint64))).sum()))
    assert 50 < np.mean(counts) < 52.5 and min(counts) >= m.MATCHES
