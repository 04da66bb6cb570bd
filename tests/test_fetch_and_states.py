"""Retries with growing pauses, charts, checkpoints of spending, and states carried over years."""

from __future__ import annotations

import math
from xml.etree import ElementTree

import numpy as np
import pytest

from scholium.operators import forecast
from scholium.sources import fetch, sinks


def test_pauses_double_up_to_the_cap():
    slept = []

    def call(attempt):
        if attempt < 5:
            raise ConnectionError if attempt != 3 else fetch.Busy(9.0)
        return "done"

    assert fetch.retried(call, 6, 1.0, 5.0, slept.append) == ("done", 5, None) and slept == [1.0, 2.0, 5.0, 5.0]
    assert fetch.retried(call, 2, 0.0, 0.0, slept.append) == (None, 2, "ConnectionError")
    with pytest.raises(KeyError):
        fetch.retried(lambda attempt: {}["x"], 3, 0.0, 0.0)


def test_chart_and_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("a<b", 4.0), ("none", None), ("c", 2.0)], "name string, n double")
    root = ElementTree.fromstring(sinks.svg_bars(rows, "name", "n"))
    assert [float(x.get("width")) for x in root if x.tag.endswith("rect")] == [480.0, 0.0, 240.0]
    charges = spark.createDataFrame([(1, 1, "m", 2.0), (1, 2, "m", 3.0), (2, 3, "k", 1.0)], "budget long, seq long, model string, cost double")
    sinks.write_checkpoint(charges, str(tmp_path))
    assert {(r["budget"], r["total"], r["calls"]) for r in spark.read.json(f"{tmp_path}/totals").collect()} == {(1, 5.0, 2), (2, 1.0, 1)}
    assert spark.read.json(f"{tmp_path}/records").count() == 3


def test_states_over_years(spark):
    rng = np.random.default_rng(1)
    cell = forecast.Cell(rng.normal(size=(9, 2)), rng.normal(size=(9, 3)), rng.normal(size=9), rng.normal(size=9))
    rows = [(n, 2000 + y, rng.normal(size=2).tolist()) for n in range(5) for y in range(n)]
    got = {(r["id"], r["year"]): r["state"] for r in forecast.carry_states(spark.createDataFrame(rows, "id long, year int, x array<double>"), cell).collect()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    state: dict[int, list[float]] = {}
    for n, year, x in rows:
        h = state.get(n, [0.0] * 3)
        a = [sum(cell.w[i, k] * x[k] for k in range(2)) + cell.b[i] for i in range(9)]
        c = [sum(cell.u[i, k] * h[k] for k in range(3)) + cell.c[i] for i in range(9)]
        new = []
        for i in range(3):
            r, z = sigmoid(a[i] + c[i]), sigmoid(a[3 + i] + c[3 + i])
            new.append((1 - z) * math.tanh(a[6 + i] + r * c[6 + i]) + z * h[i])
        state[n] = new
        assert got[n, year] == pytest.approx(new)
    assert len(got) == len(rows)
