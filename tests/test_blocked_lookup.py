"""Blocked lookups against all pairs, greedy pairs against a plain loop, ranged numbers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholium.functions.fuzzy import token_sort
from scholium.operators import forecast, resolve


def plain_tiers(texts, variants, threshold, whole=False):
    out = {}
    for text in set(texts):
        key = text.strip(" ").lower()
        exact = [c for _, v, c in sorted(variants) if v == key]
        if whole:
            part = [c for _, v, c in sorted(variants) if f" {v} " in f" {key} "]
        else:
            part = [c for _, v, c in sorted(variants) if v in key or key in v]
        near = sorted((-token_sort(key, v), p, c) for p, v, c in variants if token_sort(key, v) >= threshold)
        if exact or part:
            out[text] = ((exact or part)[0], 0.95, "kb")
        elif near:
            out[text] = (near[0][2], round(0.9 * -near[0][0] / 100, 9), "fuzzy")
        else:
            out[text] = (text, 0.3, "none")
    return out


def test_tiers_equal_all_pairs(spark):
    rnd = random.Random(7)
    words = ["lund", "univ", "of", "ab", "college", "jena", "x", "institute", "tech", "north"]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))
    variants = [(n, v, f"C{n}") for n, v in enumerate(dict.fromkeys(name() for _ in range(25)))]
    texts = ["", "  ", "zz"]
    for _ in range(150):
        t = list(rnd.choice([name(), rnd.choice(variants)[1]]))
        for _ in range(rnd.randrange(4)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("abcdefgh ")
        texts.append("".join(t).title())
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kb = spark.createDataFrame(variants, "pos int, variant string, canonical string")
    for threshold, whole in ((80.0, False), (62.0, True)):
        got = {r["text"]: (r["canonical"], round(r["confidence"], 9), r["source"]) for r in resolve.lookup_tiers(df, kb, threshold, whole).collect()}
        assert got == plain_tiers(texts, variants, threshold, whole)
        assert {s for _, _, s in got.values()} == {"kb", "fuzzy", "none"}


def test_greedy_pairs_take_the_first_that_fits(spark):
    pred = [(1, "Ann Lee"), (1, "Ann  LEA"), (1, "Bo"), (2, "Cy"), (3, "lee ann")]
    gold = [(1, "Ann Leo"), (1, "ann lee"), (1, "Lee Ann"), (2, "Dee"), (3, "Ann Lee")]
    p, g = (spark.createDataFrame(x, "paper_id long, name string") for x in (pred, gold))
    want = set()
    for paper in (1, 2, 3):
        free = sorted(n for i, n in gold if i == paper)
        for one in sorted(n for i, n in pred if i == paper):
            hit = next((n for n in free if token_sort(one.lower().strip(), n.lower().strip()) >= 85), None)
            if hit:
                free.remove(hit)
                want.add((paper, one, hit))
    assert {(r["paper_id"], r["pred"], r["gold"]) for r in resolve.greedy_pairs(p, g).collect()} == want and len(want) == 3
    best = {(r["pred"], r["gold"], r["score"]) for r in resolve.greedy_pairs(p, g, best=True).filter("paper_id = 3").collect()}
    assert best == {("lee ann", "Ann Lee", 100.0)}


def test_features_of_given_pairs(spark):
    rnd = random.Random(4)
    half = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(120)) if a != b}
    e = spark.createDataFrame(sorted(half | {(b, a) for a, b in half}), "a long, b long")
    whole = {(r["a"], r["b"]): (r["common"], r["adamic"]) for r in forecast.link_features(e).collect()}
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(a + 1, 30)], "a long, b long")
    got = {(r["a"], r["b"]): (r["common"], r["adamic"]) for r in forecast.features_of(pairs, e).collect()}
    assert got == {p: x for p, x in whole.items() if p[0] < 10} and got


def test_numbers_over_ranges(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("k"), F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("v"))
    got = forecast.row_numbers(df, "k", "v", "place", ranges=7).collect()
    want = sorted((r["k"], r["v"]) for r in got)
    assert sorted((r["place"], (r["k"], r["v"])) for r in got) == list(enumerate(want, 1))
    assert forecast.row_numbers(df.limit(0), "k", "v", "place").count() == 0
