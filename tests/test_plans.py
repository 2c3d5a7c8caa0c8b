"""Plan-shape guards for scale: every registered query, checked on its physical plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from roomtrace.plans import catalog

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    E.queries()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan is what would run at scale
    try:
        yield {n: plan_of(fn(spark, SF_SMALL)) for n, fn in catalog.RAW.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_cartesian_nested_loop_or_python(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_top_n_limits_before_shuffle(plans):
    for n in ["top_gaps", "first_rows", "recent_readings", "monthly_color_modes", "discomfort_days"]:
        assert "WindowGroupLimit" in plans[n] and "Partial" in plans[n], n


def test_time_range_literal_pushes_to_scan(spark):
    from roomtrace.functions.timefn import time_range
    from roomtrace.sources.fixtures import readings_r1

    df = time_range(readings_r1(spark, SF_SMALL), "24h", as_of=dt.datetime(2024, 1, 20))
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz" in p


def test_time_gaps_windows_by_device_and_bucket(plans):
    p = plans["time_gaps"]
    assert "windowspecdefinition(device_id" in p
    assert "hashpartitioning(device_id#" in p and "_b#" in p.split("hashpartitioning(device_id#", 1)[1][:40]


def test_join_small_leaves_the_form_to_measured_sizes(spark):
    from roomtrace.operators import joins

    big = spark.range(0, 1000).withColumn("k", F.col("id") % 10)
    small = spark.range(0, 10).withColumnRenamed("id", "k")
    joined = joins.join_small(big, small, "k")
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString() and joined.count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(joins.join_small(big, small, "k"))
        assert joins.join_small(big, small, "k").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_building_a_query_runs_no_job(spark):
    # these write tables to the shared folder while they are built
    eager = {"insight_sections", "live_rollup", "rollup_store_stale", "rollup_store_refresh"}
    tracker = spark.sparkContext.statusTracker()
    before, started = set(tracker.getJobIdsForGroup(None)), {}
    for n, fn in catalog.RAW.items():
        fn(spark, SF_SMALL)
        now = set(tracker.getJobIdsForGroup(None))
        started[n], before = len(now - before), now
    assert {n for n, k in started.items() if k} <= eager


def test_hot_device_windows_spread_over_tasks(spark):
    """One device holding most rows still spreads over many window partitions (device x hour bucket)."""
    from roomtrace.operators.series import time_gaps
    from roomtrace.schema import READINGS_SCHEMA

    rows = spark.range(0, 20000).selectExpr(
        "cast(case when id % 10 = 0 then 1 else 0 end as int) as device_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 7 as decimal(18, 6))) as gw_timestamp",
        "cast(id % 100 as double) as timestamp_monotonic")
    for f in READINGS_SCHEMA.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    g = time_gaps(rows).withColumn("pid", F.spark_partition_id())
    parts = g.where("device_id = 0").select("pid").distinct().count()
    assert parts > 1
    assert g.where("device_id = 0 and gw_gap_s is null").count() == 1


def test_shared_inputs_are_computed_once(plans):
    # raw-row scans per plan: a second pass over the same input shows up as an extra FileScan
    most = {"hourly_resample": 1, "top_episodes": 1, "light_days": 2, "anomaly_summary": 2, "monthly_top_color": 2,
            "insights": 2, "kpis": 2, "cadence_summary": 2, "time_gaps": 2, "schema_profile": 1, "column_summary": 2,
            "lag_matrix": 1, "compare_series": 1, "weekly_overlay": 1, "previous_similar": 4}
    assert {n: plans[n].count("FileScan") for n in most} == most


def test_profiles_and_insights_have_no_expand_of_raw_rows(plans):
    assert all("Expand" not in plans[n] for n in ("schema_profile", "column_summary", "kpis", "cadence_summary"))


def test_context_window_presents_rows_before_they_pair(spark):
    """Rounding and times as text cost far more than a pair: none of them stands above the unfolding of the pairs."""
    df = catalog.QUERIES["context_window"](spark, SF_SMALL)
    pairs, sides = df._jdf.queryExecution().optimizedPlan().toString().split("Generate inline", 1)
    assert not any(x in pairs for x in ("round(", "cast(", "rpad(", "format_string("))
    assert "round(" in sides and "rpad(" in sides


def test_rollups_are_routed_to_stored_tables(spark):
    """A long range over a fresh store reads days, the hours at its edges, and raw rows of the edge hours only."""
    import os
    import tempfile

    from roomtrace.sources import rollups, sinks
    from roomtrace.sources.fixtures import readings_r2
    from roomtrace.sources.readers import scan_readings

    folder = tempfile.mkdtemp(prefix="roomtrace-test-")
    sinks.sink_append(readings_r2(spark, SF_SMALL), os.path.join(folder, "raw"))
    raw = scan_readings(spark, os.path.join(folder, "raw"), fmt="parquet")
    root = rollups.build_rollups(raw, os.path.join(folder, "rollups"))
    rows = rollups.covering_rows(raw, root, dt.datetime(2024, 1, 3, 5, 10), dt.datetime(2024, 4, 10, 17, 45))
    p = plan_of(rows)
    assert "rollups/daily" in p and "rollups/hourly" in p
    scan = next(x for x in p.split("FileScan")[1:] if "/raw" in x)
    assert "reading_date" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "2024-01-03" in scan
