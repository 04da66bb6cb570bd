"""Clusters are closed under links, however long the chain."""

from __future__ import annotations

from scholium.operators import graph, resolve


def test_a_chain_of_many_links_is_one_cluster(spark):
    chain = [(i, "x", "a" * (40 - i) + "b" * i) for i in range(41)]  # only neighbours reach 97
    df = spark.createDataFrame([*chain, (99, "x", "zzzz"), (100, "y", "a" * 40)], "record_id int, block string, name string")
    got = dict(tuple(r) for r in resolve.clusters(df, 97.0).collect())
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 100}


def test_components_of_shuffled_paths(spark):
    order = [(i * 37) % 101 for i in range(101)]
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(200, 201), (202, 201), (5, 5)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}
