"""Hand-made frames per operator: nulls, ties, zero variance, tiny groups, DST days, invariants."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomtrace.functions import exprs as X
from roomtrace.functions.timefn import localize, period_map, range_hours, time_range
from roomtrace.operators import anomalies as A
from roomtrace.operators import color, comfort, grain, profiles, series, stats
from roomtrace.operators.clean import clean_drop, clean_mask, coerce_numeric, infer_utc_offset, project_sensors
from roomtrace.schema import READINGS_SCHEMA

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def readings(spark, rows):
    """rows: list of dicts with any subset of the readings columns."""
    from pyspark.sql import types as T

    cols = [f.name for f in READINGS_SCHEMA.fields]
    dbl = {f.name for f in READINGS_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)}

    def fix(c, v):
        return float(v) if c in dbl and v is not None else v

    full = [{c: fix(c, r.get(c, 0 if c == "device_id" else None)) for c in cols} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], READINGS_SCHEMA)


def series_rows(n, start=T0, step_s=30, **vals):
    out = []
    for i in range(n):
        r = {"gw_timestamp": start + dt.timedelta(seconds=i * step_s), "timestamp_monotonic": float(i * step_s)}
        for k, v in vals.items():
            r[k] = v(i) if callable(v) else v
        out.append(r)
    return out


def test_empty_frame_flows_through(spark):
    df = readings(spark, [])
    assert grain.hourly_resample(clean_mask(df)).count() == 0
    assert stats.statistics(df).count() == 0
    assert A.anomalies_z(df).count() == 0


def test_clean_rules(spark):
    df = readings(spark, [
        {"gw_timestamp": T0, "pressure": 899.0, "light": 70001},
        {"gw_timestamp": T0, "pressure": 900.0, "light": 70000},
        {"gw_timestamp": None, "pressure": 1000.0, "light": 1},
        {"gw_timestamp": T0, "pressure": None, "light": 5},
    ])
    m = clean_mask(df).orderBy(F.col("pressure").asc_nulls_last()).collect()
    assert len(m) == 3
    assert [r.pressure for r in m] == [900.0, None, None]
    d = clean_drop(df).collect()
    assert [(r.pressure, r.light) for r in d] == [(899.0, 70001), (900.0, 70000), (1000.0, 1)]


def test_coerce_numeric_strict_and_lenient(spark):
    df = spark.createDataFrame([("123.0", "7", "NaN", "abc")], ["light", "sound_level", "humidity", "pressure"])
    lenient = coerce_numeric(df).collect()[0]
    strict = coerce_numeric(df, strict_ints=True).collect()[0]
    assert lenient.light == 123 and strict.light is None
    assert lenient.sound_level == 7 and lenient.humidity is None and lenient.pressure is None


def test_percent_rank_avg_matches_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, None]
    df = spark.createDataFrame([(0, v) for v in vals], "device_id int, v double")
    got = sorted((r.v, r.p) for r in df.select("v", profiles.percent_rank_avg("v").alias("p")).collect()
                 if r.v is not None)
    want = pd.Series(vals).rank(pct=True)
    assert [p for _, p in got] == pytest.approx(sorted(want.dropna().tolist()))
    assert [p for _, p in got] == pytest.approx([0.25, 0.625, 0.625, 1.0])


def test_first_max_takes_earliest_tie(spark):
    rows = series_rows(5, light=lambda i: 10 if i in (1, 3) else 1)
    df = readings(spark, rows)
    r = df.groupBy().agg(X.first_max("light", "gw_timestamp").alias("pk")).collect()[0].pk
    assert r.o == T0 + dt.timedelta(seconds=30)


def test_safe_corr_zero_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.select(X.safe_corr("x", "y").alias("r")).collect()[0].r is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.0)], "x double, y double")
    r = df2.select(X.safe_corr("x", "y").alias("r")).collect()[0].r
    want = pd.DataFrame({"x": [1, 2, 3, 4.0], "y": [2, 4.1, None, 8]}).corr().iloc[0, 1]
    assert r == pytest.approx(want)


def test_discomfort_null_guard_and_value(spark):
    df = spark.createDataFrame([(90.0, 20.0, 220), (None, 10.0, 500), (70.0, 50.0, 10)],
                               "t double, h double, s bigint")
    got = [r.d for r in df.select(X.discomfort("t", "h", "s").alias("d")).collect()]
    assert got[0] == pytest.approx(0.5 * 2 + 2 + 0.03 * 100)
    assert got[1] is None
    assert got[2] == 0.0


def test_comfort_bands_and_heat_index(spark):
    df = spark.createDataFrame([(71.0, 45.0, 1000, 50), (85.0, 70.0, 100, 500), (None, 45.0, 1000, 50)],
                               "t double, h double, l bigint, s bigint")
    sc = X.comfort_scores("t", "h", "l", "s")
    rows = df.select(sc["comfort_index"].alias("c"), sc["rating"].alias("r"),
                     X.heat_index("t", "h").alias("hi")).collect()
    assert rows[0].c == 100.0 and rows[0].r == "Excellent" and rows[0].hi == 71.0
    # 85F: max(0, 100-70)=30; RH 70: max(0,100-75)=25; light 100 -> 60; sound 500 -> 80
    assert rows[1].c == pytest.approx(round(30 * .4 + 25 * .3 + 60 * .15 + 80 * .15, 1))
    assert rows[1].hi == pytest.approx(round(
        -42.379 + 2.04901523 * 85 + 10.14333127 * 70 - .22475541 * 85 * 70 - 6.83783e-3 * 85 ** 2
        - 5.481717e-2 * 70 ** 2 + 1.22874e-3 * 85 ** 2 * 70 + 8.5282e-4 * 85 * 70 ** 2 - 1.99e-6 * 85 ** 2 * 70 ** 2, 1))
    assert rows[2].c is None and rows[2].r is None


def test_device_conversions(spark):
    df = spark.createDataFrame([(786, 0, None, [32768] * 159 + [32768 + 160])], "r int, g int, b int, s array<int>")
    row = df.select(X.rgb_to_hex("r", "g", "b").alias("h"), X.sound_rms("s").alias("rms")).collect()[0]
    assert row.h == "#FF0000"
    assert row.rms == round(math.sqrt(160 ** 2 / 160))


def test_hex_parsing(spark):
    df = spark.createDataFrame([("#FFD4A3",), ("bad",), (None,), ("#ffd4a3",), ("#FFD4A",)], ["c"])
    rows = df.select(X.parse_hex("c").alias("p"), X.color_name("c").alias("n")).collect()
    assert tuple(rows[0].p) == (255, 212, 163) and rows[0].n == "Warm White"
    assert rows[1].p is None and rows[2].p is None and rows[4].p is None
    assert rows[3].n == "Warm White"


def test_localize_dst_days(spark):
    # 2025-11-02 06:30Z and 07:30Z both show local hour 1; 2025-03-09 08:30Z is 03:30 CDT.
    df = readings(spark, [{"gw_timestamp": dt.datetime(2025, 11, 2, 6, 30)},
                          {"gw_timestamp": dt.datetime(2025, 11, 2, 7, 30)},
                          {"gw_timestamp": dt.datetime(2025, 3, 9, 8, 30)}])
    rows = localize(df).orderBy("gw_timestamp").collect()
    assert [r.hour for r in rows] == [3, 1, 1]
    h = grain.hourly_resample(df.where(F.month("gw_timestamp") == 11), spine=False)
    assert h.count() == 2  # the fall-back hour keeps two UTC bins


def test_hour_spine_and_empty_hours(spark):
    rows = [{"gw_timestamp": T0, "light": 1}, {"gw_timestamp": T0 + dt.timedelta(hours=3), "light": 2}]
    h = grain.hourly_resample(readings(spark, rows)).orderBy("hour_ts").collect()
    assert [r.rows for r in h] == [1, 0, 0, 1]
    assert h[1].light is None


def test_time_gaps_bucketed_equals_whole_series(spark):
    import random

    random.seed(7)
    t, rows = T0, []
    for i in range(400):
        t += dt.timedelta(seconds=random.choice([5, 30, 600, 5000]))
        rows.append({"device_id": i % 2, "gw_timestamp": t, "timestamp_monotonic": float(random.randint(0, 100))})
    df = readings(spark, rows)
    got = {(r.device_id, r.gw_timestamp): (r.gw_gap_s, r.mono_gap_s) for r in series.time_gaps(df).collect()}
    pdf = pd.DataFrame(rows).sort_values(["device_id", "gw_timestamp"])
    pdf["g"] = pdf.groupby("device_id")["gw_timestamp"].diff().dt.total_seconds()
    pdf["m"] = pdf.groupby("device_id")["timestamp_monotonic"].diff()
    for r in pdf.itertuples():
        g, m = got[(r.device_id, r.gw_timestamp.to_pydatetime())]
        assert (g is None and math.isnan(r.g)) or g == pytest.approx(r.g)
        assert (m is None and math.isnan(r.m)) or m == pytest.approx(r.m)


def test_moving_average_halo_equals_range_window(spark):
    rows = series_rows(300, step_s=47, light=lambda i: (i * 37) % 101)
    df = readings(spark, rows)
    got = {r.gw_timestamp: r.light_ma for r in A.moving_average(df, "light", window_s=600, bucket_s=3600).collect()}
    pdf = pd.DataFrame(rows).set_index("gw_timestamp")
    want = pdf["light"].astype(float).rolling("601s").mean()
    for ts, v in want.items():
        assert got[ts.to_pydatetime()] == pytest.approx(v)


def test_prev_in_series_equals_lag(spark):
    rows = series_rows(200, step_s=997, light=lambda i: i)
    df = readings(spark, rows)
    out = A.prev_in_series(df, ["device_id"], "gw_timestamp", ["light"], bucket="1 hour").orderBy("gw_timestamp")
    got = [r.prev_light for r in out.collect()]
    assert got == [None] + list(range(199))


def test_robust_z_zero_mad_and_episode_edges(spark):
    # constant sensors -> MAD 0 -> rz all 0; an event run touching the last hour still closes
    rows = []
    for h in range(48):
        rows.append({"gw_timestamp": T0 + dt.timedelta(hours=h), "temperature_sht": 70.0, "humidity": 40.0,
                     "pressure": 1000.0, "light": 100 if h < 46 else 90000, "sound_level": 10})
    hourly = grain.hourly_resample(clean_drop(readings(spark, rows)))
    sc = series.anomaly_score(hourly).orderBy("hour_ts").collect()
    assert all(r.temp_rz == 0.0 for r in sc)
    eps = series.episodes(series.anomaly_score(hourly)).collect()
    assert len(eps) >= 1 and max(e.end for e in eps) == T0 + dt.timedelta(hours=47)


def test_episodes_islands(spark):
    hours = [0, 1, 2, 5, 6, 9]
    df = spark.createDataFrame(
        [(0, T0 + dt.timedelta(hours=h), float(h), True, 1.0, 2.0, 3.0, 4.0, 5.0) for h in hours],
        "device_id int, hour_ts timestamp_ntz, anomaly_score double, is_event boolean, light double, sound double, "
        "humidity double, temp double, pressure double")
    eps = sorted((e.start.hour, e.duration_h) for e in series.episodes(df).collect())
    assert eps == [(0, 3.0), (5, 2.0), (9, 1.0)]
    merged = sorted((e.start.hour, e.duration_h) for e in series.episodes(df, max_gap_hours=3).collect())
    assert merged == [(0, 10.0)]


def test_light_days_sample_threshold(spark):
    day1 = series_rows(49, start=dt.datetime(2024, 1, 2, 15), step_s=60, light=lambda i: 200 + i)
    day2 = series_rows(50, start=dt.datetime(2024, 1, 3, 15), step_s=60, light=lambda i: 200 + i)
    ld = profiles.light_days(localize(readings(spark, day1 + day2))).collect()
    assert [r.date for r in ld] == [dt.date(2024, 1, 3)]
    assert ld[0].peak_light == 249.0


def test_monthly_top_color_black_only(spark):
    rows = [{"gw_timestamp": T0 + dt.timedelta(hours=i), "pressure": 1000.0, "light": 1,
             "color_hex": "#000000"} for i in range(3)]
    df = readings(spark, rows)
    off = infer_utc_offset(df)
    from roomtrace.operators.clean import apply_offset

    out = profiles.monthly_top_color(apply_offset(df, off)).collect()
    assert [r.color_hex for r in out] == ["#000000"]


def test_color_mode_shares_sum_to_one(spark):
    rows = [{"gw_timestamp": T0 + dt.timedelta(minutes=i), "color_hex": c}
            for i, c in enumerate(["#000000", "#FF0000", "#0000FF", "#808080", "#FF0000"])]
    m = color.monthly_color_modes(color.color_frame(localize(readings(spark, rows)))).collect()[0]
    assert m.dark_share + m.warm_share + m.cool_share + m.neutral_share == pytest.approx(1.0)
    assert m.warm_share == pytest.approx(0.4)


def test_correlation_matrix_symmetric_unit_diagonal(spark):
    rows = series_rows(60, temperature_sht=lambda i: 60 + i % 7, humidity=lambda i: 30.0 + (i * 3) % 11,
                       pressure=lambda i: 1000.0 + i % 5, light=lambda i: i * 3, sound_level=lambda i: i % 13)
    m = {(r.x, r.y): r.r for r in stats.correlation_matrix(readings(spark, rows)).collect()}
    for (x, y), r in m.items():
        assert r == pytest.approx(m[(y, x)])
        if x == y:
            assert r == pytest.approx(1.0)


def test_rollup_merge_equals_raw(spark):
    rows = series_rows(500, step_s=173, temperature_sht=lambda i: 60 + (i * 7) % 13 * 0.25, light=lambda i: i % 50)
    df = readings(spark, rows)
    merged = {(r.sensor, r.bucket): r for r in grain.rollup_from_rollup(grain.rollup(df, "hourly"), "daily").collect()}
    raw = {(r.sensor, r.bucket): r for r in grain.rollup(df, "daily").collect()}
    assert merged.keys() == raw.keys()
    for k, r in raw.items():
        assert merged[k].avg == pytest.approx(r.avg) and merged[k]["count"] == r["count"]
        assert (r.std is None and merged[k].std is None) or merged[k].std == pytest.approx(r.std)
    st = {r.sensor: r for r in grain.stats_from_rollup(grain.rollup(df, "hourly")).collect()}
    full = {r.sensor: r for r in stats.statistics(df).collect()}
    for s, r in st.items():
        assert r.mean == pytest.approx(full[s].mean) and r.std == pytest.approx(full[s].std_dev)


def test_anomalies_need_30_rows(spark):
    few = readings(spark, series_rows(29, light=lambda i: 1000 if i == 5 else 1))
    assert A.anomalies_z(few, ["light"]).count() == 0
    many = readings(spark, series_rows(40, light=lambda i: 1000 if i == 5 else 1))
    got = A.anomalies_z(many, ["light"]).collect()
    assert len(got) == 1 and got[0].severity == "severe"


def test_time_range_tokens(spark):
    rows = series_rows(100, step_s=3600, light=1)
    df = readings(spark, rows)
    assert time_range(df, "24h").count() == 25
    assert time_range(df, "all").count() == 100
    with pytest.warns(UserWarning, match="unknown time range"):
        assert time_range(df, "bogus").count() == 2  # unknown -> 1 hour
    assert time_range(df, {"start": T0, "end": T0 + dt.timedelta(hours=10)}).count() == 10
    assert range_hours("7d") == 168 and period_map("8w") == "56d" and period_map("x") == "28d"


def test_project_sensors_validates(spark):
    with pytest.raises(ValueError):
        project_sensors(readings(spark, []), ["nope"])


def test_weekly_pattern_has_168_cells(spark):
    df = readings(spark, series_rows(10, temperature_sht=70.0))
    g = stats.weekly_pattern(df, "temperature_sht")
    assert g.count() == 168 and g.where(F.col("value").isNotNull()).count() == 1


def test_discomfort_days_top8_nulls_last(spark):
    rows = []
    for d in range(10):
        for i in range(3):
            rows.append({"gw_timestamp": dt.datetime(2024, 1, 1 + d, 18, i), "temperature_sht": 80.0 + d,
                         "humidity": 30.0, "sound_level": 10 if d else None})
    top = comfort.discomfort_days(localize(readings(spark, rows))).collect()
    assert len(top) == 8


def test_trend_needs_ten_rows(spark):
    from roomtrace.operators import insights as I

    nine = readings(spark, series_rows(9, step_s=86400, temperature_sht=lambda i: 60.0 + 3 * i))
    assert I.insight_trend(nine).count() == 0
    ten = readings(spark, series_rows(10, step_s=86400, temperature_sht=lambda i: 60.0 + 3 * i))
    r = I.insight_trend(ten).collect()
    assert len(r) == 1 and r[0].metric == pytest.approx(3.0) and r[0].priority == "high"


def test_all_null_sensor_statistics(spark):
    df = readings(spark, series_rows(5, humidity=None, temperature_sht=lambda i: 60.0 + i))
    s = {r.sensor: r for r in stats.statistics(df).collect()}
    h = s["humidity"]
    assert h["count"] == 5 and h.missing_count == 5 and h.missing_percent == 100.0
    assert h.mean is None and h.min_timestamp is None
    assert s["temperature_sht"].median == 62.0


def test_quality_flags_counts_duplicates(spark):
    from roomtrace.operators.quality import quality_flags

    rows = series_rows(3, light=0, temperature_sht=-1.0)
    df = readings(spark, rows + rows[:2] + rows[:1])
    q = quality_flags(df).collect()[0]
    assert q.duplicate_rows == 3 and q.zero_light == 6 and q.negative_temperature == 6


def test_spring_forward_day_local_labels(spark):
    # 2025-03-09 in America/Chicago has 23 local hours; every UTC hour keeps its own bin
    rows = series_rows(24 * 12, start=dt.datetime(2025, 3, 9, 6, 0), step_s=300, light=1)
    h = grain.hourly_resample(readings(spark, rows)).where(F.col("local_date") == dt.date(2025, 3, 9)).collect()
    assert len(h) == 23 and 2 not in {r.hour for r in h}


def test_nearest_reading_equals_brute_force(spark):
    """Equal times, equal distances, NULL times and sensors, events between readings, near midnight and without readings."""
    import random

    r = random.Random(5)
    hours = [0, 1, 5, 22, 23, 24, 25, 30, 47, 71]
    rows = [{"gw_timestamp": T0 + dt.timedelta(hours=r.choice(hours), seconds=r.randrange(0, 3600, 600)), "device_id": r.randrange(2),
             "temperature_sht": r.choice([None, 1, 2]), "light": r.randrange(3)} for _ in range(120)]
    rows += [{"gw_timestamp": None, "temperature_sht": 9}]
    ev = {(r.randrange(2), r.choice(["light", "humidity"]), T0 + dt.timedelta(hours=r.choice([*hours, 10, 33, 60]), seconds=r.randrange(0, 3600, 300)))
          for _ in range(80)}
    df = readings(spark, rows)
    events = spark.createDataFrame([*ev, *list(ev)[:3]], "device_id long, sensor string, event_ts timestamp_ntz")
    got = {(x.device_id, x.sensor, x.event_ts): (x.gw_timestamp, x.temperature_sht, x.light) for x in A.nearest_reading(df, events).collect()}
    want = {}
    for d, sensor, t in ev:
        near = [(abs(x["gw_timestamp"] - t), x["gw_timestamp"], x["temperature_sht"] is not None, x["temperature_sht"] or 0, x["light"], x)
                for x in rows if x.get("device_id", 0) == d and x["gw_timestamp"] is not None
                and t - dt.timedelta(hours=3) <= x["gw_timestamp"] < t + dt.timedelta(hours=3)]
        if near:
            x = min(near, key=lambda y: y[:5])[5]
            want[d, sensor, t] = (x["gw_timestamp"], x["temperature_sht"], x["light"])
    assert got == want and 0 < len(want) < len(ev)


def test_cadence_medians_equal_percentile(spark):
    """Even and odd numbers of gaps, repeated gaps, one reading only, an outage."""
    times = {0: [0, 1.5, 3, 7, 7, 4000], 1: [0, 30, 60, 90.25], 2: [5]}
    df = readings(spark, [{"device_id": d, "gw_timestamp": T0 + dt.timedelta(seconds=t), "timestamp_monotonic": t, "temperature_sht": t % 7}
                          for d, ts in times.items() for t in ts])
    gaps = localize(series.time_gaps(df), "UTC")
    want = {x.device_id: x for x in gaps.groupBy("device_id").agg(
        F.percentile("gw_gap_s", 0.5).alias("gap"), F.percentile("temperature_sht", 0.5).alias("temp")).collect()}
    for x in series.cadence_summary(gaps).collect():
        assert x.median_gap_s == want[x.device_id].gap and x.first_ts == T0 + dt.timedelta(seconds=min(times[x.device_id]))
    for x in series.kpis(gaps).collect():
        assert (x.median_cadence_s, x.median_temp) == (want[x.device_id].gap, want[x.device_id].temp)
        assert x.active_dates == 1 and x.outages_gt_1h == (x.device_id == 0)
    assert series.cadence_summary(gaps.limit(0)).count() == 0 and series.kpis(gaps.limit(0)).count() == 0


def test_medians_of_a_hot_device_are_taken_from_few_of_its_values(spark):
    """Distributed selection equals exact percentiles, whatever the distribution; no task ranks all values of a device."""
    import random

    from pyspark.sql import Window

    r = random.Random(5)
    rows = [(0, "gap", round(r.expovariate(1 / 30), 6)) for _ in range(20_000)] + [(0, "gap", 30.0)] * 15_000
    rows += [(0, "temp", r.choice([70.0, 70.5, None])) for _ in range(500)] + [(1, "gap", 10.0 ** r.randrange(-9, 300)) for _ in range(999)]
    rows += [(2, "gap", 4.0), (2, "gap", 5.0), (3, "gap", None), (None, "gap", 1.0), (None, "gap", 2.0)]
    df = spark.createDataFrame(rows, "device_id int, kind string, value double").repartition(4)
    n = df.groupBy("device_id", "kind", "value").agg(F.count("value").alias("n"), F.max(F.lit(T0).cast("timestamp_ntz")).alias("_t0"), F.max(F.lit(T0).cast("timestamp_ntz")).alias("_t1"))
    want = {(x.device_id, x.kind): x.m for x in df.groupBy("device_id", "kind").agg(F.percentile("value", 0.5).alias("m")).collect() if x.m is not None}
    got = series.median_of_counts(n)
    assert {(x.device_id, x.kind): x["median"] for x in got.collect()} == want
    # of the hot device's values, the final window sees one range of 64 (two where the middle falls between)
    seen = []
    plain = Window.partitionBy
    try:
        Window.partitionBy = staticmethod(lambda *k: seen.append(k) or plain(*k))
        series.median_of_counts(n)
    finally:
        Window.partitionBy = plain
    assert all("_r" in k for k in seen if k != ("device_id", "kind")) and len(seen) == 2
    cuts = n.where("device_id = 0 and kind = 'gap'").agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 6400)).first()[0]
    values = sorted(v for d, k, v in set(rows) if d == 0 and k == "gap")
    assert max(sum(a < v <= b for v in values) for a, b in zip([-1, *cuts], [*cuts, 1e9])) < len(values) / 50


def test_previous_similar_is_brute_force(spark):
    """Ties in size and time, several buckets, sizes that grow or fall over many of them, several series."""
    import random

    r = random.Random(11)
    rows = []
    for d, sensor, size in ((0, "light", lambda i: r.choice([2.5, 2.75, 3.0, -2.5, -3.5])), (0, "humidity", lambda i: 2.5 + i * 0.01),
                            (1, "light", lambda i: 9 - i * 0.01), (2, "light", lambda i: r.uniform(2.5, 9))):
        for i in range(150):
            rows.append((d, T0 + dt.timedelta(hours=r.randrange(0, 24 * 9)), sensor, float(i), size(i), "severe"))
    df = spark.createDataFrame(rows, "device_id int, gw_timestamp timestamp_ntz, sensor string, value double, z_score double, severity string").repartition(3)
    for bucket in ("1 day", "1 hour", "30 days"):
        got = sorted((tuple(x) for x in A.previous_similar(df, bucket).collect()), key=str)
        want = sorted(((*x, max((y[1] for y in rows if y[0] == x[0] and y[2] == x[2] and y[1] < x[1] and abs(y[4]) >= abs(x[4])), default=None))
                       for x in rows), key=str)
        assert got == want
    assert A.previous_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("w", [1, 2, 10])
def test_row_count_average_equals_a_whole_series_window(spark, w):
    """Gaps longer than buckets, sparse buckets, ties in time, NULL values, several devices."""
    import random

    from pyspark.sql import Window

    r = random.Random(w)
    rows, t = [], 0.0
    for i in range(400):
        t += r.choice([0, 1, 60, 60, 900, 4000, 30_000])
        rows.append({"device_id": i % 2, "gw_timestamp": T0 + dt.timedelta(seconds=t), "timestamp_monotonic": float(i), "humidity": r.choice([None, float(i)])})
    df = readings(spark, rows).repartition(4)
    win = Window.partitionBy("device_id").orderBy("gw_timestamp", "timestamp_monotonic").rowsBetween(-(w - 1), 0)
    for least in (1, w):
        want = df.withColumn("ma", F.when(F.count(F.lit(1)).over(win) >= least, F.avg("humidity").over(win)))
        got = A.moving_average_rows(df, "humidity", rows=w, name="ma", min_rows=least)
        assert got.columns == want.columns
        a, b = ({(x.device_id, x.timestamp_monotonic): x.ma for x in d.collect()} for d in (got, want))
        assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in b)


def test_lag_matrix_blocks_equal_a_join(spark):
    """Blocks shorter than the series and than the lags, empty hours, sensors of different length."""
    import random

    r = random.Random(2)
    rows = [(d, T0 + dt.timedelta(hours=h), s, r.choice([1.0, 2.0, 5.0, r.random()])) for d in (0, 1) for h in range(-30, 200) for s in ("a", "b", "c")
            if r.random() < 0.7 and not (s == "c" and h > 60)]
    df = spark.createDataFrame(rows, "device_id int, hour_ts timestamp_ntz, sensor string, value double")
    value = {(d, t, s): v for d, t, s, v in rows}
    for lags, size in ((range(-12, 13), 240), (range(-12, 13), 24), ((0, 7, -20), 10)):
        got = {(x.device_id, x.x, x.y, x.lag_hours): x.correlation for x in stats.lag_matrix(df, lags, size).collect()}
        for d in (0, 1):
            for x in "abc":
                for y in "abc":
                    for k in lags:
                        pairs = [(v, value[d, t + dt.timedelta(hours=k), y]) for (e, t, s), v in value.items()
                                 if e == d and s == x and (d, t + dt.timedelta(hours=k), y) in value]
                        assert got[d, x, y, k] == pytest.approx(float(pd.Series([a for a, _ in pairs]).corr(pd.Series([b for _, b in pairs]))))
        assert len(got) == 2 * 9 * len(lags)


def test_profiles_count_distinct_values_over_hours(spark):
    """Values that return in other hours count once; -0.0 is 0.0; NULL times and all-NULL columns."""
    from roomtrace.operators import quality

    rows = [{"gw_timestamp": T0 + dt.timedelta(minutes=20 * (i % 30)), "humidity": [0.0, -0.0, 1.5, None][i % 4], "light": i % 7, "color_hex": f"#{i % 3}"} for i in range(60)]
    rows.append({"gw_timestamp": None, "light": 99, "color_hex": None})
    df = readings(spark, rows)
    got = {x.column: x for x in quality.schema_profile(df).collect()}
    assert {c: got[c].unique_count for c in ("gw_timestamp", "humidity", "light", "color_hex", "timestamp_iso")} == {
        "gw_timestamp": 30, "humidity": 2, "light": 8, "color_hex": 3, "timestamp_iso": 0}
    near = {x.column: x.unique_count for x in quality.schema_profile(df, approx=True).collect()}
    assert near["light"] == 8 and near["color_hex"] == 3
    text = {x.column: x for x in quality.column_summary(df).collect()}
    assert text["light"].unique_nonnull == 8 and text["gw_timestamp"].unique_nonnull == 30 and text["color_hex"].type == "categorical"
    assert quality.schema_profile(df.limit(0)).count() == 0 and quality.column_summary(df.limit(0)).count() == 0


def test_iso_text_equals_the_components_text(spark):
    """Fractions with last zeros, years before 1000 and beyond 9999, missing times."""
    times = ["1969-12-31 23:59:59.999999", "0000-01-01 00:00:00", "0999-03-04 05:06:07.1", "+10000-01-01 00:00:00.25",
             "2024-03-10 02:30:00", "2024-01-01 00:00:00.000010", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, s string").select("i", F.col("s").cast("timestamp_ntz").alias("t"))
    got = df.orderBy("i").select(X.iso_str("t"), X.iso_str("t", micros=False, sep="T")).collect()
    assert [x[0] for x in got] == ["1969-12-31 23:59:59.999999", "0000-01-01 00:00:00.000000", "0999-03-04 05:06:07.100000",
                                   "10000-01-01 00:00:00.250000", "2024-03-10 02:30:00.000000", "2024-01-01 00:00:00.000010", None]
    assert [x[1] for x in got] == ["1969-12-31T23:59:59", "0000-01-01T00:00:00", "0999-03-04T05:06:07", "10000-01-01T00:00:00",
                                   "2024-03-10T02:30:00", "2024-01-01T00:00:00", None]


def test_context_window_deals_pairs_over_tasks(spark):
    """Readings at the bounds, repeated events, missing keys; few bytes with many pairs go to many tasks."""
    rows = [{"device_id": i % 3 or None, "gw_timestamp": T0 + dt.timedelta(minutes=5 * i) if i % 50 else None, "light": i} for i in range(300)]
    df = readings(spark, rows).coalesce(1)
    events = [(r["device_id"], "light", r["gw_timestamp"]) for r in rows[::7]] * 2
    ev = spark.createDataFrame(events, "device_id int, sensor string, event_ts timestamp_ntz").coalesce(1)
    h = dt.timedelta(hours=3)
    want = sorted((e[0], e[2], r["light"]) for e in events for r in rows if None not in (e[0], e[2], r["gw_timestamp"])
                  and e[0] == r["device_id"] and e[2] - h <= r["gw_timestamp"] < e[2] + h)
    out = A.context_window(df, ev)
    assert out.columns == [*df.columns, "sensor", "event_ts"] and sorted((x.device_id, x.event_ts, x.light) for x in out.collect()) == want
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 4 and max(x["count"] for x in tasks) < len(want) / 2


def test_moving_average_of_dense_readings(spark):
    """Ties, NULL values and times, times before 1970, windows of 0 s; the work is linear in the rows of a window."""
    from pyspark.sql import Window

    rows = [{"device_id": i % 2 if i % 31 else None, "gw_timestamp": dt.datetime(1969, 12, 31, 23) + dt.timedelta(seconds=(i * 37 % 800) * 11) if i % 40 else None,
             "timestamp_monotonic": i, "humidity": (i * 7 % 13) * 0.5 if i % 5 else None} for i in range(2000)]
    df = readings(spark, rows).repartition(4)
    for s in (0, 1, 600, 1800, 9000):
        w = Window.partitionBy("device_id").orderBy(X.epoch_micros("gw_timestamp")).rangeBetween(-s * 1_000_000, 0)
        want = df.withColumn("humidity_ma", F.avg("humidity").over(w))
        got = A.moving_average(df, "humidity", window_s=s)
        assert got.columns == want.columns
        a, b = ({x.timestamp_monotonic: x for x in d.collect()} for d in (got, want))
        assert a.keys() == b.keys() and all(a[k][:-1] == b[k][:-1] and a[k].humidity_ma == pytest.approx(b[k].humidity_ma) for k in b)
    plan = A.moving_average(df, "humidity", window_s=600)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan and "RangeFrame, -" not in plan


def test_context_window_unfolds_bounded_blocks(spark):
    """Readings of one time, repeated events in blocks of at most ``block`` events, missing values; ``form`` works on the sides."""
    rows = [{"device_id": 1, "gw_timestamp": T0 + dt.timedelta(minutes=i // 50), "light": None if i % 9 == 0 else i // 2, "humidity": i / 3} for i in range(400)]
    df = readings(spark, rows).select("device_id", "gw_timestamp", "humidity", "light")
    times = [T0 + dt.timedelta(hours=3, minutes=m) for m in (0, 4, 4, 8)] + [T0 - dt.timedelta(hours=3, minutes=-2)]
    ev = spark.createDataFrame([(1, "light", t) for t in times], "device_id int, sensor string, event_ts timestamp_ntz")
    h = dt.timedelta(hours=3)
    want = sorted((t, r["gw_timestamp"], round(r["humidity"], 2), str(r["light"])) for t in times for r in rows if t - h <= r["gw_timestamp"] < t + h)

    def two_digits(d):
        return d.withColumn("humidity", F.round("humidity", 2)) if "humidity" in d.columns else d

    for block in (1, 2, 1000):
        out = A.context_window(df, ev, form=two_digits, block=block)
        assert sorted((x.event_ts, x.gw_timestamp, x.humidity, str(x.light)) for x in out.collect()) == want
    # nothing is computed for a pair but the bounds of its window
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "_events" not in top and "round(" not in top
