"""Every registered query against DuckDB on the smallest tables, and report invariants."""

import os

import oracle
import pytest

from tallyglass import catalog
from tallyglass.operators import sessions as S
from tallyglass.plans import journeys as J
from tallyglass.sources import bind as B

catalog.load()
SF = f"{oracle.TESTDATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


# One query per report family; the rest run in tests/oracle.py over all names.
SMOKE = [
    "r01_analytics_summary", "r06_patterns_404", "r12_search_gaps__totals", "r14_bridge_ctr", "r16_retention__cohorts",
    "r17_route_transitions", "r17_route_transitions__sequences", "r18_conversion_map", "r19_conversion_outcomes__coverage",
    "r20_activation_funnel", "w14_stage_since_anchor", "r22_holdout_experiment", "r26_demand_drill__totals",
    "r28_content_revenue__totals", "r29_revenue_timeseries", "r30_revenue_pages", "r32_delivery_coverage", "r33_error_summary",
    "io11_retention_purge", "st03_daily_counters",
]


@needs_data
@pytest.mark.parametrize("name", SMOKE)
def test_matches_duckdb(spark, con, name):
    status, note = oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert status in ("ok", "EMPTY"), note


@needs_data
def test_sessions_partition_the_rows(spark):
    rows = J.known_pageviews(B.events(spark, SF)).select("id", "visitor_id", "ts", "blog_id", "route_family").cache()
    table = S.session_table(rows, B.GAP_12H)
    n, sessions = rows.count(), table.count()
    assert table.agg({"rows": "sum"}).first()[0] == n
    trails = S.sessionize(rows, B.GAP_12H, node=["blog_id", "route_family"], depth=1)
    assert trails.count() == n and S.transitions(trails).count() == n - sessions


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
