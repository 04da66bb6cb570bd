"""Hand-computed edge rules."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholium.functions import fuzzy, text
from scholium.operators import agreement, analytics, forecast, graph, metrics, resolve, state, verdict


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paper_scores_without_gold_or_prediction(spark):
    gold = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "b", "x")], "paper_id int, name string, aff string")
    pred = spark.createDataFrame([(2, "a", "x"), (3, "a", "x")], "paper_id int, name string, aff string")
    papers = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "paper_id int")
    got = {r[0]: r[1:] for r in rows(metrics.paper_scores(gold, pred, papers))}
    assert got[4] == (1.0, 1.0, 1.0)
    assert got[3] == (0.0, 1.0, 0.0)
    assert got[1] == (1.0, 0.0, 0.0)
    assert got[2][:2] == (1.0, 0.5) and abs(got[2][2] - 2 / 3) < 1e-12


def test_calibration_puts_full_confidence_in_the_last_bin(spark):
    df = spark.createDataFrame([(1.0, True), (0.95, False)], "confidence double, correct boolean")
    assert abs(metrics.calibration_error(df).first()["ece"] - 0.475) < 1e-9
    assert metrics.calibration_error(df.limit(0)).first()["ece"] == 0.0


def test_kappa_of_one_category_is_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert agreement.kappa(df).first()["kappa"] == 1.0
    assert agreement.kappa(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(0, 1), (1, 0)], "a int, b int")
    assert agreement.kappa(mixed).first()["kappa"] == -1.0


def test_alpha_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([("u", "a", 1), ("u", "b", 1)], "unit string, rater string, score int")
    assert agreement.alpha_ordinal(df).first()["alpha"] == 1.0
    assert agreement.alpha_variance(df).first()["alpha"] == 1.0


def test_verdict_ladder(spark):
    items = [("e1", "registry"), ("e2", "merge")]
    schema = "candidate_id int, n_specialists int, evidence array<struct<id:string,tool:string>>, decision string, confidence double, evidence_ids array<string>, retry_hint string"
    data = [
        (1, 1, items, "accept", 0.9, [], None), (2, 1, [], "accept", 0.9, [], None), (3, 2, items, "reject", 0.4, [], None),
        (4, 2, items, None, None, None, None), (5, 1, items, None, None, None, None), (6, 1, items, "retry", 0.5, ["x"], "again"),
    ]
    got = {r["candidate_id"]: r for r in verdict.judge(spark.createDataFrame(data, schema)).collect()}
    assert (got[1]["decision"], got[1]["evidence_ids"]) == ("accept", ["e1", "e2"])
    assert (got[2]["decision"], got[2]["salvage"]) == ("reject", False)
    assert (got[3]["decision"], got[3]["confidence"], got[3]["evidence_ids"], got[3]["salvage"]) == ("accept", 0.5, ["e2"], True)
    assert (got[4]["decision"], got[4]["confidence"], got[4]["confidence_band"]) == ("accept", 0.45, "low")
    assert (got[5]["decision"], got[5]["confidence"]) == ("reject", 0.2)
    assert (got[6]["decision"], got[6]["retry_hint"]) == ("retry", "again")


def test_upsert_twice_is_once(spark):
    new = spark.createDataFrame([("a", 1, None, 1), ("a", None, 2, 2)], "k string, x int, y int, ingest_seq int")
    once = graph.upsert_nodes(new.limit(0), new, "k")
    assert rows(once) == rows(graph.upsert_nodes(once, new, "k")) == [("a", 1, 2, 2)]


def test_modes_agree_for_authors_of_one_paper_and_differ_otherwise(spark):
    papers = spark.createDataFrame([(1, 2020, "v"), (2, 2020, "w")], "paper_id long, year int, venue_key string")
    inst = spark.createDataFrame([(1, "I", "C", "company")], "inst_id int, inst_name string, country string, org_type string")
    authored = spark.createDataFrame([(7, 1, 0), (7, 2, 0)], "author_id long, paper_id long, position int")
    affil = spark.createDataFrame([(7, 1, 1, 2020), (7, 1, 2, 2020)], "author_id long, inst_id int, paper_id long, year int")
    one = graph.industry_share(affil, authored, papers, inst, venue="V")
    fan = graph.industry_share(affil, authored, papers, inst, venue="V", mode="reference")
    assert (one.first()["total"], fan.first()["total"]) == (1, 2)


def test_neighborhood_of_an_unknown_author_is_its_centre(spark):
    edges = spark.createDataFrame([(1, 2, 9, 2020), (2, 1, 9, 2020)], "a long, b long, paper_id long, year int")
    assert rows(graph.neighborhood(edges, F.lit(5)).select("hop", "author_id")) == [(0, 5)]
    assert rows(graph.neighborhood(edges, F.lit(1)).select("hop", "author_id")) == [(0, 1), (1, 2)]


def test_merge_needs_two_specialists_for_high(spark):
    data = [("Ann  Lee", "X", "header", 0), ("ann lee", "Y", "footnote", 1), ("ann lee", "X", "footnote", 2), ("Bo", None, "email", 3), ("Z", "Q", "email", 4)]
    got = {r["key"]: r for r in resolve.merge_candidates(spark.createDataFrame(data, "name string, aff string, specialist string, pos int")).collect()}
    assert got["ann lee"]["confidence"] == "high" and got["ann lee"]["affiliations"] == ["X", "Y"] and got["ann lee"]["name"] == "Ann  Lee"
    assert got["bo"]["confidence"] == "medium" and got["bo"]["affiliations"] == []
    assert "z" not in got


def test_greedy_pairs_use_a_gold_name_once(spark):
    pred = spark.createDataFrame([(1, "Ann Lee"), (1, "Lee Ann")], "paper_id int, name string")
    gold = spark.createDataFrame([(1, "Ann Lee")], "paper_id int, name string")
    assert rows(resolve.greedy_pairs(pred, gold).select("pred", "gold")) == [("Ann Lee", "Ann Lee")]


def test_lookup_tiers(spark):
    kb = spark.createDataFrame([(0, "mit", "MIT"), (1, "stanford university", "Stanford")], "pos int, variant string, canonical string")
    texts = spark.createDataFrame([("MIT",), ("Dept, Stanford University",), ("Stanfrd Universty",), ("Submit",), ("Zürich",)], "text string")
    got = {r["text"]: (r["canonical"], r["source"]) for r in resolve.lookup_tiers(texts, kb).collect()}
    assert got["MIT"] == ("MIT", "kb") and got["Dept, Stanford University"] == ("Stanford", "kb")
    assert got["Stanfrd Universty"] == ("Stanford", "fuzzy") and got["Zürich"] == ("Zürich", "none")
    assert got["Submit"] == ("MIT", "kb")  # the containment rule takes any substring
    words = {r["text"]: r["source"] for r in resolve.lookup_tiers(texts, kb, whole_words=True).collect()}
    assert words["Submit"] == "none"


def test_author_clusters_close_over_links(spark):
    data = [(1, "b", "ann lee"), (2, "b", "ann leee"), (3, "b", "ann leeee"), (4, "b", "bob stone"), (5, "c", "ann lee")]
    df = spark.createDataFrame(data, "record_id long, block string, name string")
    assert dict(rows(resolve.clusters(df, 90.0))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_a_rejected_charge_costs_nothing(spark):
    df = spark.createDataFrame([("b", 1, 60), ("b", 2, 60), ("b", 3, 40)], "budget string, seq int, cost long")
    assert rows(metrics.replay(df, 100)) == [("b", 100, 2)]
    assert [r["over"] for r in metrics.spend(df, 100.0).orderBy("seq").collect()] == [False, True, True]


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([("v", None, 1, "a"), ("v", None, 2, "b")], "venue string, year int, seq int, summary string")
    assert rows(state.upsert(df, ["venue", "year"], "seq")) == [("v", None, 2, "b")]


def test_small_slices_become_other(spark):
    df = spark.createDataFrame([("a", 97), ("b", 2), ("c", 1)], "k string, n long")
    assert rows(analytics.with_other(df, "k", 3, 0.025)) == [("Other", 3), ("a", 97)]


def test_ranking_quality_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert rows(forecast.ranking_quality(df)) == [(0.5, 0.0)]
    perfect = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, score double")
    assert rows(forecast.ranking_quality(perfect)) == [(1.0, 1.0)]


def test_scalars(spark):
    df = spark.range(1).select(
        text.norm_aff(F.lit("  École, Normale!  Sup. ")).alias("aff"), text.venue_key(F.lit("  ")).alias("none"),
        text.org_type(F.lit("Submitted Works")).alias("loose"), text.org_type(F.lit("Submitted Works"), True).alias("strict"),
        text.name_from_email(F.lit("alice.smith@mit.edu")).alias("full"), text.name_from_email(F.lit("asmith@example.com")).alias("short"),
        text.paper_key(F.lit("doi:10.1/x")).alias("doi"), text.json_block(F.lit("a {b")).alias("bad"),
    )
    assert tuple(df.first()) == ("école normale sup", "unknown", "education", "other", "Alice Smith", "", "10.1/x", None)


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_indel_ratio(a, b):
    want = 100.0 if not a and not b else 100 * 2 * lcs(a, b) / (len(a) + len(b))
    assert fuzzy.indel_ratio(a, b) == pytest.approx(want)
    assert fuzzy.indel_ratio(a, b) == fuzzy.indel_ratio(b, a)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=10), st.text("abcd", max_size=10))
def test_jaro_winkler_bounds(a, b):
    assert 0.0 <= fuzzy.jaro_winkler_of(a, b) <= 1.0
    assert fuzzy.jaro_winkler_of(a, a) == 1.0


def test_token_sort_ignores_order():
    assert fuzzy.token_sort("b a", "a b") == 100.0
    assert fuzzy.token_sort(None, "a") is None
