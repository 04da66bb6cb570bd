"""Pairs of large groups by blocks, and no silent cuts in what is shown."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scholium.__main__ import parser, shown
from scholium.operators import graph
from scholium.sources import sinks


def test_pairs_of_groups_on_both_sides_of_the_block(spark):
    rnd = random.Random(1)
    groups = {g: sorted(rnd.sample(range(500), n)) for g, n in ((1, 90), (2, 8), (3, 9), (4, 1), (5, 200))}
    rows = spark.createDataFrame([(g, i, g * 10) for g, items in groups.items() for i in items], "g long, x long, year int").repartition(5)
    got = [tuple(r) for r in graph.pairs_within(rows, "g", "x", block=8).select("g", "year", "a", "b").collect()]
    want = [(g, g * 10, a, b) for g, items in groups.items() for a, b in itertools.combinations(items, 2)]
    assert sorted(got) == sorted(want)


def test_a_paper_of_twenty_thousand_authors(spark):
    """No cell holds more than two blocks, with some room for uneven hashes."""
    authored = spark.range(20_000).select(F.lit(1).cast("long").alias("paper_id"), F.col("id").alias("author_id"))
    sizes = authored.groupBy("paper_id").agg(F.count("*").alias("n"))
    cells = graph.block_cells(authored, "paper_id", "author_id", sizes, graph.BLOCK).groupBy("_i", "_j").count()
    most, n = cells.agg(F.max("count"), F.count("*")).first()
    assert most < 2.4 * graph.BLOCK and n == 20 * 21 // 2
    papers = spark.createDataFrame([(1, 2020)], "paper_id long, year int")
    few = authored.filter("author_id < 1500")
    assert graph.coauthors(few, papers, block=256).count() == 1500 * 1499
    inst = few.select("paper_id", (F.col("author_id") % 700).alias("inst_id"), F.lit(2020).alias("year"))
    found = graph.collaborations(inst, block=64)
    assert found.count() == 700 * 699 and found.agg(F.max("papers_count")).first()[0] == 1


def test_nothing_is_left_out_unsaid(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("name"), F.col("id").alias("n"))
    for render in (sinks.ascii_table, sinks.markdown_table, sinks.latex_table):
        assert render(rows, ["name", "n"], limit=60).count("59") == 2
        with pytest.raises(ValueError, match="more than 50 rows"):
            render(rows, ["name", "n"])
    with pytest.raises(ValueError, match="more than 40 rows"):
        sinks.svg_bars(rows, "name", "n")
    assert list(shown(rows.orderBy("n"), 55))[-1] == "5 more rows: raise --limit, or write all with --output"
    assert len(list(shown(rows, 60))) == 1
    assert parser().parse_args(["query", "top_institutions_by_venue", "g", "--output", "x"]).output == "x"
