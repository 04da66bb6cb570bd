"""Plans that must hold at scale: pruned scans, pushed filters, no cross joins of facts."""

from __future__ import annotations

from conftest import SF

from scholium.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scans_read_only_what_is_needed(spark):
    text = plan(catalog.queries()["g06_top_institutions"](spark, SF))
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text


def test_filters_reach_the_scan(spark):
    text = plan(catalog.queries()["f10_region_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in text


def test_reference_mode_counts_before_it_joins(spark):
    text = plan(catalog.queries()["g05_industry_share_reference"](spark, SF)).split("== Physical Plan ==")[1]
    assert text.count("HashAggregate") >= 6 and "CartesianProduct" not in text

