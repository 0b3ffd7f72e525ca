"""Shapes of physical plans and rules for the sources."""

from pathlib import Path

import pytest

from clickloom.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
# These run a Python function per client, or write before they read.
PYTHON = {"rate_limit_decisions", "rate_limit_by_client", "rate_limit_hot_client", "rate_limit_repeats"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"ingest_clicks", "ingest_dead_letters", "clicks_compacted", "rollup_daily_stream", "rate_limit_stream"}))
def test_no_pairing_and_no_python(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "MapInPandas" not in plan and "PythonUDF" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(catalog.queries()["timeline_global_7d"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<>" in plan_of(catalog.queries()["total_clicks"](spark, SF))


def test_clicks_are_scanned_once(spark):
    for name in ("link_report_nested", "global_report", "report_grouping_sets"):
        plan = plan_of(catalog.queries()[name](spark, SF))
        assert plan.count("events.parquet") == 1, name


def test_sources_keep_the_rules():
    files = [p for p in (ROOT / "clickloom").rglob("*.py") if "llm" not in p.parts]
    text = "\n".join(p.read_text() for p in files)
    for banned in ("localCheckpoint", ".crossJoin(", ".toPandas(", ".collect(", "current_timestamp(", ".rdd"):
        assert banned not in text, banned


def test_merge_aggregates_by_hash(spark):
    plan = plan_of(catalog.links_merge(spark, SF))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_bloom_joins_drop_the_words(spark, monkeypatch):
    """No word array passes an exchange behind the join that reads it."""
    from clickloom.operators import bloom

    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 0)
    plan = plan_of(catalog.bloom_probe(spark, SF))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert line.count("words") <= 1
