"""Readers, sinks and the streaming paths (batch equals stream; replays are idempotent)."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from roomtrace.functions.timefn import time_range
from roomtrace.operators import grain
from roomtrace.schema import READINGS_COLUMNS
from roomtrace.sources import rollups, sinks
from roomtrace.sources.fixtures import message_lines, readings_r1
from roomtrace.sources.readers import parse_event_time, scan_readings, scan_weather
from roomtrace.streaming import live
from roomtrace.streaming.live import live_pipeline, live_rollup, parse_messages


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*[F.col(c).cast("string") for c in cols]).fillna("NULL").collect())


def test_parse_event_time_variants(spark):
    df = spark.createDataFrame([("2025-04-06T12:00:00.5+00:00",), ("2025-04-06T07:00:00-05:00",),
                                ("2025-04-06 12:00:00",), ("2025-04-06T12:00:00Z",), ("junk",), (None,),
                                ("2025-04-06T17:30:00+05:30",)], ["t"])
    got = [r.p for r in df.select(parse_event_time("t").alias("p")).collect()]
    assert [str(g) if g else None for g in got] == [
        "2025-04-06 12:00:00.500000", "2025-04-06 12:00:00", "2025-04-06 12:00:00", "2025-04-06 12:00:00",
        None, None, "2025-04-06 12:00:00"]


def test_csv_roundtrip_equals_source(spark, scratch):
    src = readings_r1(spark, SF_SMALL)
    path = os.path.join(scratch, "store_csv")
    sinks.export_all(src, path, fmt="csv")
    back = scan_readings(spark, path, fmt="csv")
    cols = ["device_id", "gw_timestamp", "temperature_sht", "humidity", "pressure", "light", "sound_level", "color_hex"]
    assert _rows(back, cols) == _rows(src, cols)


def test_json_lines_and_parquet_readers(spark, scratch):
    src = readings_r1(spark, SF_SMALL)
    jp = os.path.join(scratch, "store_json")
    sinks.as_csv_rows(src).write.json(jp)
    back = scan_readings(spark, jp, fmt="json")
    assert back.count() == src.count()
    pp = os.path.join(scratch, "store_parquet")
    sinks.sink_append(src, pp, fmt="parquet")
    assert scan_readings(spark, pp, fmt="parquet").count() == src.count()


def test_scan_weather_document(spark, scratch):
    doc = {"hourly": {"time": ["2025-11-02T00:00", "2025-11-02T01:00", "2025-11-02T02:00"],
                      "temperature_2m": [10.0, None, 12.0], "pressure_msl": [1010.0, 1011.0, 1012.0],
                      "precipitation": [0.0, 1.5, 0.0], "rain": [0.0, 1.0, 0.0], "wind_gusts_10m": [5.0, 6.0, 7.0]}}
    p = os.path.join(scratch, "weather.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    w = scan_weather(spark, p).orderBy("hour_ts").collect()
    assert [str(r.hour_ts) for r in w] == ["2025-11-02 05:00:00", "2025-11-02 06:00:00", "2025-11-02 08:00:00"]
    assert w[1].temperature_2m is None
    assert scan_weather(spark, None) is None


def test_export_range_empty_raises(spark, scratch):
    src = readings_r1(spark, SF_SMALL)
    with pytest.raises(ValueError):
        sinks.export_range(src, os.path.join(scratch, "x"), {"start": "2030-01-01", "end": "2030-01-02"})
    out = sinks.export_range(src, os.path.join(scratch, "y"), "24h")
    assert spark.read.option("header", True).csv(out).count() > 0


def test_store_is_pruned_by_date(spark, scratch):
    """Ranges over the date-partitioned store: equal rows, filters on the partitions, also without ``as_of``."""
    src = readings_r1(spark, SF_SMALL).unionByName(readings_r1(spark, SF_SMALL).limit(2).withColumn("gw_timestamp", F.lit(None).cast("timestamp_ntz")))
    path = os.path.join(scratch, "store_dated")
    sinks.sink_append(src, path)
    store = scan_readings(spark, path, fmt="parquet")
    assert store.count() == src.count()
    cols = ["device_id", "gw_timestamp", "temperature_sht", "color_hex"]
    newest = src.agg(F.max("gw_timestamp")).first()[0]
    for token, as_of in (("24h", newest), ("7d", newest), ({"start": "2024-01-05 06:00:00", "end": "2024-01-07 12:00:00"}, None), ("24h", None), ("all", None)):
        got = time_range(store, token, as_of)
        assert _rows(got, cols) == _rows(time_range(src, token, as_of), cols)
        if token != "all":
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "reading_date" in plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]


def test_rollup_upsert_is_idempotent(spark, scratch):
    roll = grain.rollup(readings_r1(spark, SF_SMALL), "daily")
    p = os.path.join(scratch, "roll")
    sinks.rollup_upsert(roll, p)
    sinks.rollup_upsert(roll, p)
    assert spark.read.parquet(p).count() == roll.count()
    st = sinks.rollup_state(spark, p).collect()
    assert len(st) == 2


def test_rollup_upsert_replaces_by_key_only(spark, scratch):
    full = grain.rollup(readings_r1(spark, SF_SMALL), "hourly")
    p = os.path.join(scratch, "roll")
    sinks.rollup_upsert(full.where("device_id = 0").withColumn("avg", F.lit(-1.0)), p)
    sinks.rollup_upsert(full.where("device_id = 1"), p)  # the same dates, other keys
    part = full.where("device_id = 0 and hour(bucket) < 12")  # part of each day
    sinks.rollup_upsert(part, p)
    got = spark.read.parquet(p)
    assert got.count() == full.count()
    assert got.where("avg = -1.0").count() == full.where("device_id = 0 and hour(bucket) >= 12").count()


def test_feed_messages_non_null_only(spark):
    src = readings_r1(spark, SF_SMALL)
    fm = sinks.feed_messages(src)
    expected = sum(src.where(F.col(c).isNotNull()).count()
                   for c in ["temperature_sht", "humidity", "pressure", "light", "sound_level", "color_hex"])
    assert fm.count() == expected
    assert {r.feed_key for r in fm.select("feed_key").distinct().collect()} == {
        "temperature-sht", "humidity", "pressure", "light", "sound-level", "color-hex"}


def test_parse_messages_filters_and_converts(spark):
    lines = spark.createDataFrame([('{"timestamp_monotonic": 5.0, "temperature_sht": 20.0, "light": 7}',),
                                   ("",), ("not json",), ("[1, 2]",), ('{"light": 5}',),
                                   ('  {"timestamp_monotonic": null, "temperature_sht": null}  ',)], ["value"])
    out = parse_messages(lines).collect()
    assert len(out) == 2
    assert sorted([r.temperature_sht for r in out], key=lambda v: (v is None, v)) == [68.0, None]


def _write_lines(spark, sf_dir, d, parts=3):
    lines = message_lines(spark, sf_dir)
    lines.select("value").repartition(parts).write.mode("overwrite").text(d)
    return lines


def test_live_pipeline_batch_equals_stream_and_idempotent(spark, scratch):
    src_dir, out, ck = (os.path.join(scratch, n) for n in ("in", "out", "ck"))
    lines = _write_lines(spark, SF_SMALL, src_dir)
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    q = live_pipeline(spark, src_dir, out, ck, stamp=stamp, recent_n=50, max_files=1)
    q.awaitTermination(300)
    stored = spark.read.parquet(f"{out}/store")
    batch = parse_messages(lines.select("value"), stamp=stamp)
    cols = [c for c in READINGS_COLUMNS if c != "gw_timestamp"]
    assert _rows(stored, cols) == _rows(batch, cols)
    # replay: a second run over the same checkpoint processes nothing new and changes nothing
    q2 = live_pipeline(spark, src_dir, out, ck, stamp=stamp, recent_n=50)
    q2.awaitTermination(300)
    assert spark.read.parquet(f"{out}/store").count() == batch.count()
    feeds = spark.read.parquet(f"{out}/feeds")
    assert feeds.count() == sinks.feed_messages(batch).count()
    last = max(int(p.split("=")[1]) for p in os.listdir(f"{out}/recent") if p.startswith("v="))
    recent = spark.read.parquet(f"{out}/recent/v={last}")
    assert recent.groupBy("device_id").count().agg(F.max("count")).collect()[0][0] <= 50


def _equal_rollups(got, want):
    cols = ["avg", "min", "max", "std", "count", "sum", "m2"]
    got, want = ({(r.device_id, r.sensor, r.bucket): [r[c] for c in cols] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, x in want.items():
        for c, a, b in zip(cols, got[k], x):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1.0, abs(b), abs(x[-2]))), (k, c, a, b)


def _arrivals(spark):
    """Readings in three parts: one hour comes with the last part, some readings come twice."""
    src = readings_r1(spark, SF_SMALL)
    day = F.dayofmonth("gw_timestamp")
    late = (F.col("device_id") == 1) & (day == 3) & (F.hour("gw_timestamp") == 5)
    twice = src.where("device_id = 0").where(day == 12)
    return [src.where((day <= 10) & ~late), src.where((day > 10) & (day <= 20) & ~late), src.where((day > 20) | late).unionByName(twice)]


@pytest.mark.parametrize("distinct", [False, True])
def test_live_rollup_equals_batch(spark, scratch, distinct):
    parts = _arrivals(spark)
    src_dir, out, ck = (os.path.join(scratch, n) for n in ("src", "roll", "ck"))
    for p in parts:
        p.write.mode("append").parquet(src_dir)
        live_rollup(spark, src_dir, out, ck, watermark="40 days", distinct=distinct).awaitTermination(600)
    every = spark.read.parquet(src_dir)
    every = every.dropDuplicates() if distinct else every
    _equal_rollups(spark.read.parquet(f"{out}/hourly"), grain.rollup(every, "hourly"))
    _equal_rollups(spark.read.parquet(f"{out}/daily"), grain.rollup(every, "daily"))


def test_merged_batch_may_stop_anywhere(spark, scratch, monkeypatch):
    """A batch that fails between or within its steps and is run again is merged once."""
    parts, root = _arrivals(spark), os.path.join(scratch, "roll")
    put = rollups._put
    for i, p in enumerate(parts):
        for stop in (0, 1, 2):
            calls = []

            def failing(rows, path):
                calls.append(path)
                if len(calls) > stop:
                    raise RuntimeError("lost")
                put(rows, path)

            monkeypatch.setattr(rollups, "_put", failing)
            if stop < 2:
                with pytest.raises(RuntimeError):
                    rollups.merge_batch(p, root, i)
            else:
                rollups.merge_batch(p, root, i)
        monkeypatch.setattr(rollups, "_put", put)
        rollups.merge_batch(p, root, i)
    rollups.merge_batch(parts[0].limit(0), root, 3)  # nothing arrived
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    _equal_rollups(spark.read.parquet(f"{root}/hourly"), grain.rollup(every, "hourly"))
    _equal_rollups(spark.read.parquet(f"{root}/daily"), grain.rollup(every, "daily"))


def test_merged_moments_keep_their_digits(spark):
    """A tiny spread on a large mean survives many merges."""
    rows = [(0, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", 1e8 + (k % 7) * 1e-3) for k in range(600)]
    df = spark.createDataFrame(rows, "device_id int, t string, pressure double").withColumn("gw_timestamp", F.col("t").cast("timestamp_ntz"))
    parts = [grain.rollup(df.where(f"int(substr(t, 18, 2)) % 5 = {k}"), "hourly", ["pressure"]) for k in range(5)]
    whole = grain.rollup(df, "hourly", ["pressure"]).first()
    merged = rollups.merge_moments(*parts).first()
    assert merged["count"] == 600 and abs(merged["std"] - whole["std"]) < 1e-6 * whole["std"]


@pytest.mark.parametrize("start,end", [("2024-01-02 05:10:00", "2024-01-28 17:45:00"), ("2024-01-10 00:00:00", "2024-01-12 00:00:00"),
                                       ("2024-01-22 03:00:00", "2024-01-25 04:00:00"), ("2024-01-03 05:10:00", "2024-01-03 05:50:00"),
                                       ("2024-01-19 23:59:59", "2024-01-20 10:31:00"), ("2023-12-01 00:00:00", "2024-03-01 00:00:00")])
def test_router_over_a_stale_store_equals_raw(spark, scratch, start, end):
    """Devices stop at different times in the store, one is unknown to it; raw readings go on."""
    src = readings_r1(spark, SF_SMALL)
    newer = src.where("device_id = 1").where("gw_timestamp >= timestamp_ntz'2024-01-21 00:00:00'").withColumn("device_id", F.lit(7))
    src = src.unionByName(newer)
    store = os.path.join(scratch, "raw")
    sinks.sink_append(src, store)
    raw = scan_readings(spark, store, fmt="parquet")
    known = src.where("device_id < 7").where("gw_timestamp < if(device_id = 0, timestamp_ntz'2024-01-20 10:30:00', timestamp_ntz'2024-01-15 08:10:00')")
    root = rollups.build_rollups(known, os.path.join(scratch, "rollups"))
    lo, hi = map(dt.datetime.fromisoformat, (start, end))
    own = src.where((F.col("gw_timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("gw_timestamp") < F.lit(end).cast("timestamp_ntz")))
    want = {(r.device_id, r.sensor): r for r in grain.stats_from_rollup(grain.rollup(own, "monthly")).collect()}
    for g in (None, "daily", "hourly", "raw"):
        got = {(r.device_id, r.sensor): r for r in rollups.range_statistics(raw, root, lo, hi, g).collect()}
        assert got.keys() == want.keys()
        for k, x in want.items():
            y = got[k]
            assert (y["count"], y["min"], y["max"]) == (x["count"], x["min"], x["max"])
            assert abs(y["mean"] - x["mean"]) < 1e-9 * max(1, abs(x["mean"])) and (x["std"] is None or abs(y["std"] - x["std"]) < 1e-6 * max(1, x["std"]))


def test_router_reads_raw_only_at_the_edges(spark, scratch):
    src = readings_r1(spark, SF_SMALL)
    store = os.path.join(scratch, "raw")
    sinks.sink_append(src, store)
    root = rollups.build_rollups(src.where("gw_timestamp < timestamp_ntz'2024-01-20 10:30:00'"), os.path.join(scratch, "rollups"))
    lo, hi = dt.datetime(2024, 1, 3, 5, 10), dt.datetime(2024, 1, 24, 17, 45)
    rows = rollups.covering_rows(scan_readings(spark, store, fmt="parquet"), root, lo, hi, "daily")
    days = {f.split("reading_date=")[1].split("/")[0] for f in rows.inputFiles() if "/raw/" in f}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert days and "reading_date" in plan
    raw_rows = scan_readings(spark, store, fmt="parquet")
    pruned = rollups._stored_days(raw_rows, (lo, dt.datetime(2024, 1, 3, 6)), (dt.datetime(2024, 1, 20, 10), hi))
    read = {str(r[0]) for r in pruned.select("reading_date").distinct().collect()}
    assert read == {"2024-01-03", *(f"2024-01-{d}" for d in range(20, 25))}


def test_refresh_replaces_the_last_hours(spark, scratch):
    src = readings_r1(spark, SF_SMALL)
    root = rollups.build_rollups(src.where("gw_timestamp < timestamp_ntz'2024-01-20 10:30:00'"), os.path.join(scratch, "rollups"))
    as_of = dt.datetime(2024, 1, 21, 9, 15)
    for _ in range(2):  # run again: the same
        rollups.refresh_rollups(src, root, as_of)
    now = src.where("gw_timestamp <= timestamp_ntz'2024-01-21 09:15:00'")
    _equal_rollups(spark.read.parquet(f"{root}/hourly"), grain.rollup(now, "hourly"))
    _equal_rollups(spark.read.parquet(f"{root}/daily"), grain.rollup(now, "daily"))


def test_recent_table_survives_a_stop_between_rows_and_commit(spark, scratch, monkeypatch):
    src = readings_r1(spark, SF_SMALL).orderBy("gw_timestamp", "device_id")
    parts = [src.where(F.dayofmonth("gw_timestamp").between(*d)) for d in ((1, 8), (9, 16), (17, 24), (25, 31))]
    folder, plain = os.path.join(scratch, "recent"), live.commit_version
    assert live.read_recent(spark, folder) is None
    for i, p in enumerate(parts):
        if i in (1, 3):
            def lost(*_):
                raise RuntimeError("lost")
            monkeypatch.setattr(live, "commit_version", lost)
            with pytest.raises(RuntimeError):
                live.recent_merge(spark, p, folder, i, 40)
            assert live.committed_versions(spark, folder)[-1] == i - 1  # readers still see the version before
            monkeypatch.setattr(live, "commit_version", plain)
        live.recent_merge(spark, p, folder, i, 40)
        live.recent_merge(spark, p, folder, i, 40)  # run again
    want = grain_top(src, 40)
    assert _rows(live.read_recent(spark, folder), READINGS_COLUMNS) == _rows(want, READINGS_COLUMNS)
    assert live.committed_versions(spark, folder) == [2, 3]
    assert sorted(x for x in os.listdir(folder) if x.startswith("v=")) == ["v=2", "v=3"]
    shutil.rmtree(os.path.join(folder, "v=3"))  # a committed version that is gone is an error, not an empty table
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        live.recent_merge(spark, parts[0], folder, 4, 40)


def grain_top(src, n):
    from roomtrace.operators.series import top_n

    return top_n(src.select(*READINGS_COLUMNS), n, [F.desc("gw_timestamp"), F.desc("timestamp_monotonic"), F.xxhash64(*READINGS_COLUMNS)])


def test_exports_and_sections_roundtrip(spark, scratch):
    from roomtrace.operators.anomalies import anomalies_z
    from roomtrace.operators.clean import clean_mask
    from roomtrace.operators.stats import statistics
    from roomtrace.plans.dashboard import build_sections, offset_sections
    from roomtrace.sources.fixtures import weather_w1

    src = clean_mask(readings_r1(spark, SF_SMALL))
    p = sinks.export_selected(src, os.path.join(scratch, "sel"), ["temperature_sht", "light"], with_zscore=True,
                              moving_avg_s=600)
    sel = spark.read.option("header", True).csv(p)
    assert {"temperature_sht_zscore", "light_ma", "temperature_sht_ma"} <= set(sel.columns)
    assert sel.count() == src.count()
    st = statistics(src)
    out = sinks.export_json(src, os.path.join(scratch, "json"), ["humidity"], stats=st)
    assert spark.read.json(f"{out}/data").count() == src.count()
    assert spark.read.json(f"{out}/statistics").count() == st.count()
    assert spark.read.json(f"{out}/metadata").count() == 2
    an = anomalies_z(src)
    rep = spark.read.option("header", True).csv(sinks.export_anomaly_report(an, os.path.join(scratch, "rep")))
    assert rep.count() == an.count() and "abs_deviation" in rep.columns
    assert spark.read.json(sinks.export_stats(st, os.path.join(scratch, "st"), fmt="json")).count() == st.count()
    secs = build_sections(readings_r1(spark, SF_SMALL), weather_w1(spark))
    secs.update(offset_sections(readings_r1(spark, SF_SMALL)))
    d = sinks.sink_sections({k: secs[k] for k in ["insights", "kpis", "workday_pulse", "weather_compare"]},
                            os.path.join(scratch, "sections"))
    assert spark.read.json(f"{d}/insights").count() == 18
    assert spark.read.json(f"{d}/workday_pulse").count() > 0
    fp = sinks.sink_feeds(src, os.path.join(scratch, "feeds"))
    assert spark.read.parquet(fp).count() == sinks.feed_messages(src).count()


def test_materialize_writes_pruned_table_in_checkpoint_folder(spark):
    from roomtrace.operators.clean import clean_mask
    from roomtrace.plans.dashboard import materialize
    from roomtrace.session import checkpoint_dir

    src = clean_mask(readings_r1(spark, SF_SMALL))
    m = materialize(src, cut=True)
    assert materialize(src, cut=False) is src
    base = checkpoint_dir(spark).rstrip("/").replace("file:", "")
    files = m.inputFiles()
    assert files and all(base in f.replace("file://", "").replace("file:", "") for f in files)
    p = m.select("device_id", "light").where("light > 100")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<device_id:int,light:bigint>" in p and "PushedFilters: [IsNotNull(light)" in p
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, src.collect()))
