"""Physical plans: no cross joins, no Python, group limits and column pruning in place."""

import os

import pytest

from tidemeter.catalog import load

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load()
BATCH = sorted(
    name for name, q in CATALOG.items()
    if q.build.__module__.rsplit(".", 1)[-1] not in ("ingest", "live"))


def plan(spark, name):
    return CATALOG[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_python(spark):
    found = {}
    for name in BATCH:
        text = plan(spark, name)
        bad = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python") if op in text]
        if bad:
            found[name] = bad
    assert found == {}


@pytest.mark.parametrize("name", ["claude_records", "session_replay", "session_titles", "top_projects_by_day"])
def test_rank_filters_trim_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") >= 2


def test_scan_reads_only_what_is_summed(spark):
    text = plan(spark, "weekday_totals")
    schema = next(line for line in text.splitlines() if "ReadSchema" in line).split("ReadSchema:")[1]
    assert "l_quantity" in schema
    assert "l_orderkey" not in schema and "l_partkey" not in schema and "l_suppkey" not in schema


def test_first_pass_aggregates_by_hash(spark):
    for name in ("totals_by_day", "field_coverage", "top_sessions", "session_totals"):
        assert "SortAggregate" not in plan(spark, name)
