"""Rows of a task are bounded: partitions grow with the lines."""

import pytest
from conftest import SF

from scholium.operators import graph
from scholium.plans import graph_queries
from scholium.sources import scratch, sinks, testdata as t


@pytest.mark.parametrize("role", ["authored", "affiliated", "gold", "predicted", "flat_rows"])
def test_roles_of_lines_have_more_partitions_for_more_lines(spark, monkeypatch, role):
    monkeypatch.setattr(scratch, "ROWS", 250)
    wanted = -(-t.table(spark, SF, "lineitem").count() // 250)
    assert getattr(t, role)(spark, SF).rdd.getNumPartitions() == wanted


def test_collaborations_keep_them_until_pairs_are_counted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 250)
    plan = graph.collaborations(t.affiliated(spark, SF))._jdf.queryExecution().executedPlan().toString()
    wanted = -(-t.table(spark, SF, "lineitem").count() // 250)
    by_paper = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "(a#" not in line]
    assert by_paper and all(f", {wanted})" in line for line in by_paper), by_paper


def test_pairs_of_parts_too(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 250)
    assert graph_queries._part_edges(spark, SF).rdd.getNumPartitions() == -(-2 * t.table(spark, SF, "lineitem").count() // 250)


def test_a_file_of_the_report_has_few_rows(spark, tmp_path):
    sinks.write_report(spark.range(100, numPartitions=1).selectExpr("cast(id as string) as paper_id"), spark.range(1), str(tmp_path), "now", rows=10)
    files = list((tmp_path / "affiliations_now.csv").glob("*.csv"))
    assert len(files) == 10 and sum(len(f.read_text().splitlines()) - 1 for f in files) == 100
