"""Similar and contained strings against all pairs, and how few pairs are compared."""

from __future__ import annotations

import random

import pytest

from scholium.functions.fuzzy import token_sort
from scholium.operators import resolve, similar

WORDS = ["univ", "university", "institute", "college", "lund", "jena", "tech", "north", "of", "the", "x", "ab", "school", "é", "zürich"]


def names(seed, n, typos=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        t = list(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 5))))
        for _ in range(rnd.randrange(typos + 1)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = [rnd.choice("abcdef é")] * rnd.randrange(2)
        out.append("".join(t))
    return [*out, "", " ", "a", "aaaa aaaa", "aaaaaaaaaa"]


@pytest.mark.parametrize("threshold", [100.0, 90.0, 81.3, 80.0, 70.0, 66.0, 40.0])
def test_similar_equals_all_pairs(spark, threshold):
    left, right = names(1, 60), names(2, 60)
    a, b = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "t"), (right, "o")))
    want = {(x, y, round(token_sort(x, y), 9)) for x in set(left) for y in set(right) if token_sort(x, y) >= threshold}
    assert {(r["t"], r["o"], round(r["score"], 9)) for r in similar.similar(a, b, "t", "o", threshold).collect()} == want


def test_few_pairs_of_like_length_are_compared(spark):
    rnd = random.Random(5)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5)))
    words = [word() for _ in range(800)]
    name = lambda: " ".join(rnd.choice(words) for _ in range(3))[:22]
    left, right = [name() for _ in range(2000)], [name() for _ in range(2000)]
    for i in range(0, 2000, 10):  # some are one another's with typos
        t = list(left[i])
        t[rnd.randrange(len(t))] = "q"
        right[i] = "".join(t)
    a, b = (spark.createDataFrame([(" ".join(sorted(x.split())),) for x in xs], "s string") for xs in (left, right))
    pairs = similar.candidates(a, b, 80.0).collect()
    assert len(pairs) < 0.02 * 2000 * 2000
    found = {(r["a"], r["b"]) for r in pairs}
    for i in range(0, 2000, 10):
        x, y = (" ".join(sorted(t[i].split())) for t in (left, right))
        assert token_sort(x, y) < 80 or (x, y) in found


def test_contained_equals_all_pairs(spark):
    holders, inner = names(3, 80), [*names(4, 40), "uni", "un", "u", "niv", "of", "university of", "é"]
    a, b = (spark.createDataFrame([(x,) for x in set(xs)], f"{c} string") for xs, c in ((holders, "h"), (inner, "i")))
    want = {(x, y) for x in holders for y in inner if y in x}
    assert {tuple(r) for r in similar.containing(a, b, "h", "i").select("h", "i").collect()} == want
    whole = {(x, y) for x in holders for y in inner if f" {y} " in f" {x} "}
    assert {tuple(r) for r in similar.containing(a, b, "h", "i", whole_words=True).select("h", "i").collect()} == whole


def test_a_common_beginning_costs_no_product(spark):
    """Every name begins alike; what meets is what the rarest part leaves."""
    holders = spark.createDataFrame([(f"university {i:05d} town",) for i in range(3000)], "h string")
    inner = spark.createDataFrame([(f"university {i:05d}",) for i in range(0, 6000, 2)], "i string")
    joined = similar.containing(holders, inner, "h", "i")
    assert joined.count() == 1500
    met = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in met
    # 'ity', ' to' and the like are never chosen: those of the digits are
    route = similar.containing(holders, inner.limit(50), "h", "i")
    assert route.count() == 50


def test_mentions(spark):
    names_ = [(k, n, i) for i, (k, n) in enumerate([("a", "Lund University"), ("a", "University of Lund"), ("b", "Lund"), ("a", "LUNDA"), ("a", "Jena")])]
    known = spark.createDataFrame(names_, "kind string, name string, id long")
    asked = spark.createDataFrame([("lund", "a"), ("Lund", "b"), ("zz", "a"), ("n", "a")], "mention string, kind string")
    got = {tuple(r) for r in resolve.link_mentions(asked, known, 2).collect()}
    assert got == {("lund", "a", 0), ("lund", "a", 1), ("Lund", "b", 2), ("n", "a", 0), ("n", "a", 1)}
