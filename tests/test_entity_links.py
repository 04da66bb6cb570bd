"""Mentions and contained names: exploded texts are never broadcast, and repeated names meet once."""

import re

from scholium.operators import resolve, similar


def test_exploded_texts_are_not_broadcast(spark, tmp_path):
    """Of a stored table Spark knows the size, and would broadcast a small one with all its parts."""
    spark.createDataFrame([(i, f"name number {i} of a few") for i in range(50)], "id long, name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    held = spark.createDataFrame([("number 7",), ("few",)], "inner string")
    plan = similar.containing(names, held, "name", "inner")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    depth, under = [len(re.match(r"[ :+|-]*", line).group()) for line in plan.splitlines()], None
    for at, line in zip(depth, plan.splitlines()):
        under = at if "BroadcastExchange" in line and under is None else None if under is not None and at <= under else under
        assert under is None or "Generate" not in line, plan


def test_repeated_names(spark):
    names = spark.createDataFrame([(i, "k" if i % 2 else "l", f"Large Ring {i % 4}") for i in range(400)], "id long, kind string, name string")
    mentions = spark.createDataFrame([("ring", "k"), ("ring", "k"), ("RING 3", "k"), ("ring 2", "k"), ("arge", "l"), (None, "l")], "mention string, kind string")
    found = sorted(tuple(r) for r in resolve.link_mentions(mentions, names).collect())
    assert found == sorted([("ring", "k", i) for i in (1, 3, 5)] + [("RING 3", "k", i) for i in (3, 7, 11)] + [("arge", "l", i) for i in (0, 2, 4)])
