"""Bootstrap intervals over all papers of a system."""

from __future__ import annotations

import random

from conftest import SF

from scholium.operators import metrics
from scholium.plans import catalog, metric_queries
from scholium.sources import testdata as t


def test_the_query_draws_from_every_paper(spark):
    scores = metric_queries._scores(spark, SF).join(t.papers(spark, SF).select("paper_id", "venue_key"), "paper_id").collect()
    got = {r["venue_key"]: r for r in catalog.queries()["a37_bootstrap"](spark, SF).collect()}
    assert set(got) == {r["venue_key"] for r in scores}
    for system, r in got.items():
        values = [x["f1"] for x in scores if x["venue_key"] == system]
        assert abs(r["mean"] - sum(values) / len(values)) < 1e-9 and r["low"] <= r["mean"] <= r["high"]


def test_counted_draws_agree_with_rows_drawn_one_by_one(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(200)]
    r = metrics.bootstrap(spark.createDataFrame([("s", v) for v in values], "system string, f1 double"), "system", "f1").first()
    means = sorted(sum(rng.choices(values, k=200)) / 200 for _ in range(2000))
    assert abs(r["low"] - means[50]) < 0.01 and abs(r["high"] - means[1950]) < 0.01
