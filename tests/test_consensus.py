"""Votes over aligned spans: the alignment against every orderly matching, and whole documents."""

from __future__ import annotations

import random
from functools import lru_cache

from scholium.functions.fuzzy import jaro_winkler_of
from scholium.operators import layout

WORDS = ["alpha beta", "alpha betas", "gamma delta", "epsilon", "zeta eta", "theta iota kappa"]


def best_total(a, b, alike):
    """The highest total similarity of matchings that keep both orders."""

    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0.0
        near = jaro_winkler_of(a[i], b[j])
        met = near + best(i + 1, j + 1) if near >= alike else 0.0
        return max(met, best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def test_alignment_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice(WORDS) for _ in range(rnd.randrange(6))] for _ in range(2))
        slots = layout.aligned([[("x", t)] for t in a], b, "y", 0.92)
        assert [t for s in slots for p, t in s if p == "x"] == a and [t for s in slots for p, t in s if p == "y"] == b
        total = sum(jaro_winkler_of(s[0][1], s[1][1]) for s in slots if len(s) == 2)
        assert abs(total - best_total(tuple(a), tuple(b), 0.92)) < 1e-9


def test_votes(spark):
    rows = [
        (1, "header", "docling", 0, "A Title"), (1, "header", "docling", 1, "Ann Lee"), (1, "header", "docling", 2, "only here"),
        (1, "header", "marker", 0, "A Title"), (1, "header", "marker", 5, "Ann Leo"), (1, "header", "marker", 6, "Second line"),
        (1, "header", "nougat", 0, "Ann Leo"), (1, "header", "nougat", 1, "Second line"), (1, "header", "other", 0, "never"),
        (2, "header", "nougat", 0, "alone"), (2, "footnotes", "nougat", 1, "* note"), (2, "footnotes", "nougat", 0, None),
        (3, "header", "docling", 0, "one of two"), (3, "footnotes", "marker", 0, "another"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, region string, parser string, pos int, text string")
    got = {tuple(r) for r in layout.consensus_by_vote(df, ["docling", "marker", "nougat"]).collect()}
    assert got == {
        (1, "header", 0, "A Title", 2), (1, "header", 1, "Ann Leo", 3), (1, "header", 2, "Second line", 2), (2, "header", 0, "alone", 1), (2, "footnotes", 0, "* note", 1),
    }
    assert layout.consensus_by_vote(df.limit(0), ["docling"]).count() == 0
