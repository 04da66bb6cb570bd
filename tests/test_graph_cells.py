"""The graph network on all neighbours and pairs: equal to rows that hold all of them, and as many pairs as links in the query."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_graphnet import planted

from scholium.operators import forecast, graphcells, graphnet
from scholium.plans import catalog


@pytest.mark.parametrize("within", [0, 1])
def test_gradient_and_scores_equal_those_of_all_neighbours(spark, monkeypatch, within):
    """Some 25 neighbours a node; with ``within``, most edges and pairs stand in one chunk."""
    if within:
        monkeypatch.setattr(graphcells, "CHUNKS", 2)
    kind, edges = planted(n=60, years=(2019, 2020, 2021, 2022))
    nodes = spark.createDataFrame([(7 * i, [float(k == j) for j in range(6)]) for i, k in kind.items()] + [(9999, [0.5] * 6)], "id long, x array<double>")
    one = spark.createDataFrame([(7 * a, 7 * b, y) for a, b, y in edges], "a long, b long, year int")
    both = one.union(one.select("b", "a", "year"))
    alone = spark.createDataFrame([(2020, 21, 9999, 0), (2020, 9999, 14, 1)], "year int, a long, b long, label int")
    pairs = forecast.positives(one).select("year", "a", "b", "label").union(alone).cache()
    net = graphnet.Network(6, 5, 2).start(3)
    rows = graphnet.examples(pairs, nodes, both, steps=2, features=6, neighbours=1000)
    loss, slope, n = graphnet.whole_gradient(net, rows)
    cells = graphcells.Cells(nodes, both, [2018, 2019, 2020, 2021], 6, 2)
    got = cells.gradient(net, cells.pairs(pairs))
    assert got[2] == n == pairs.count() > 50 and got[0] == pytest.approx(loss) and got[1] == pytest.approx(slope, abs=1e-9)
    assert got[1] != pytest.approx(graphnet.whole_gradient(net, graphnet.examples(pairs, nodes, both, 2, 6, neighbours=4))[1], abs=1e-3)
    some = pairs.filter("year = 2020")
    want = {(r["a"], r["b"]): r["score"] for r in graphnet.scores(net, some.select("a", "b", "label"), nodes, both.filter("year <= 2020"), 2020).collect()}
    scored = {(r["a"], r["b"]): r["score"] for r in cells.scores(net, some).collect()}
    assert scored == pytest.approx(want) and len(scored) == some.count()
    assert cells.gradient(net, cells.pairs(pairs.limit(0)))[2] == 0
    trained, losses = cells.train(pairs, hidden=3, epochs=2)
    other, same = graphnet.train(graphnet.examples(pairs, nodes, both, 2, 6, 1000), 6, 2, hidden=3, epochs=2)
    assert np.allclose(trained.flat, other.flat, atol=1e-7) and losses == pytest.approx(same)


def test_the_query_draws_as_many_pairs_as_links(spark):
    found = {r["label"]: r["count"] for r in catalog.queries()["g15_graph_network"](spark, SF).groupBy("label").count().collect()}
    assert found[0] == found[1]


def test_what_moves_follows_the_nodes(spark):
    """20,000 edges and as many pairs of 200 nodes: no table of an epoch has more rows than pairs of chunks."""
    nodes = spark.range(200).select("id", F.array(F.col("id") % 2, F.lit(1)).cast("array<double>").alias("x"))
    one = spark.range(20_000).selectExpr("id % 200 as a", "(id * 7 + id div 200) % 200 as b", "cast(2000 + id % 3 as int) as year").filter("a < b")
    cells = graphcells.Cells(nodes, one.union(one.select("b", "a", "year")), [2000, 2001, 2002], 2, 2)
    pairs = cells.pairs(one.selectExpr("year", "a", "b", "1 as label"))
    sent = cells._sent(cells.states(graphnet.Network(2, 3, 2).start(1)), cells.homes)
    assert max(df.count() for df in (cells.cells, cells.chunks, pairs, sent)) <= 2 * graphcells.CHUNKS**2
    assert cells.chunks.rdd.map(lambda r: r["chunk"]).distinct().count() == graphcells.CHUNKS


def test_negatives_of_each_year_by_their_own_number(spark):
    edges = spark.createDataFrame([(0, 1, 2000), (2, 3, 2001), (1, 9, 2002)], "a long, b long, year int")
    got = forecast.negatives(edges, spark.range(10), {2000: 3, 2001: 0, 2002: 1000}).groupBy("year").count().collect()
    assert {tuple(r) for r in got} == {(2000, 3), (2002, 42)}
