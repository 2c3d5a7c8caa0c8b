"""Statistics cards, correlation, heat-map grids, calendar views, scatter samples.

Per-sensor statistics run on the long form ``(device, ts, sensor, value)``:
the unpivot is a narrow Expand (no shuffle) and one partially aggregated
``groupBy(device, sensor)`` computes every measure in a single pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import epoch_micros, hour_floor, month_str, pct, safe_corr, seconds_between
from roomtrace.functions.timefn import time_range
from roomtrace.operators.joins import join_small
from roomtrace.operators.series import top_n
from roomtrace.schema import NUMERIC_SENSORS


def long_with_nulls(df: DataFrame, sensors=None, keep=("device_id", "gw_timestamp")) -> DataFrame:
    sensors = list(sensors or NUMERIC_SENSORS)
    sel = df.select(*keep, *[F.col(s).cast("double").alias(s) for s in sensors])
    return sel.unpivot(list(keep), sensors, "sensor", "value")


def statistics(df: DataFrame, sensors=None) -> DataFrame:
    """Per device and sensor: count (NULLs included), missing, min/max and their first times,
    mean, median, std, p25/p75/p95, time span in hours."""
    lf = long_with_nulls(df, sensors)
    v = F.col("value")
    q = pct("value", [0.25, 0.5, 0.75, 0.95])
    g = lf.groupBy("device_id", "sensor").agg(
        F.count(F.lit(1)).alias("count"), F.count("value").alias("_n"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std_dev"), q.alias("_q"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("k"), F.col("gw_timestamp").alias("t")))).alias("_mn"),
        F.min(F.when(v.isNotNull(), F.struct((-v).alias("k"), F.col("gw_timestamp").alias("t")))).alias("_mx"),
        F.min("gw_timestamp").alias("_t0"), F.max("gw_timestamp").alias("_t1"))
    return g.select(
        "device_id", "sensor", "count", (F.col("count") - F.col("_n")).alias("missing_count"),
        ((F.col("count") - F.col("_n")) / F.col("count") * 100.0).alias("missing_percent"),
        "min", "max", "mean", F.col("_q")[1].alias("median"), "std_dev",
        F.col("_q")[0].alias("percentile_25"), F.col("_q")[2].alias("percentile_75"),
        F.col("_q")[3].alias("percentile_95"),
        F.col("_mn.t").alias("min_timestamp"), F.col("_mx.t").alias("max_timestamp"),
        (seconds_between("_t1", "_t0") / 3600.0).alias("time_span_hours"))


def coef_variation(stats: DataFrame) -> DataFrame:
    """100 * std / mean where mean > 0, and whether the sensor is the most stable of temp/humidity/pressure."""
    cv = F.when(F.col("mean") > 0, F.col("std_dev") / F.col("mean") * 100.0)
    s = stats.select("device_id", "sensor", cv.alias("cv"))
    best = (s.where(F.col("sensor").isin("temperature_sht", "humidity", "pressure") & F.col("cv").isNotNull())
            .groupBy("device_id").agg(F.min(F.struct("cv", "sensor")).getField("sensor").alias("_best")))
    return (s.join(best, "device_id", "left")
            .withColumn("most_stable", F.coalesce(F.col("sensor") == F.col("_best"), F.lit(False))).drop("_best"))


def histogram(df: DataFrame, sensor: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram of one sensor per device, between its min and max (max in the last bin)."""
    v = F.col(sensor).cast("double")
    d = df.where(v.isNotNull()).select("device_id", v.alias("v"))
    rng = d.groupBy("device_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return (join_small(d, rng, "device_id").withColumn("bucket", b.cast("int"))
            .groupBy("device_id", "bucket").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("_lo"),
                                                 F.first("hi").alias("_hi"))
            .select("device_id", F.lit(sensor).alias("sensor"), "bucket",
                    (F.col("_lo") + (F.col("bucket") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    (F.col("_lo") + F.col("bucket") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_end"),
                    "count"))


def correlation_matrix(df: DataFrame, sensors=None) -> DataFrame:
    """Pearson r for every ordered sensor pair (pairwise complete), long form (x, y, r); one pass."""
    sensors = list(sensors or NUMERIC_SENSORS)
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i:]]
    wide = df.groupBy("device_id").agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for i, a in enumerate(sensors):
        for j, b in enumerate(sensors):
            key = f"{a}|{b}" if i <= j else f"{b}|{a}"
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("x"), F.lit(b).alias("y"),
                                  F.col(f"`{key}`").alias("r")))
    return wide.select("device_id", F.explode(F.array(*cells)).alias("c")).select("device_id", "c.*")


def correlation_class(r) -> Column:
    """Fixed bins of the heat-map legend."""
    r = F.col(r) if isinstance(r, str) else r
    return (F.when(F.abs(r - 1.0) < 0.01, "perfect").when(r >= 0.7, "strong-positive")
            .when(r >= 0.4, "moderate-positive").when(r >= -0.1, "weak-positive")
            .when(r >= -0.4, "weak-negative").when(r >= -0.7, "moderate-negative")
            .when(r.isNotNull(), "strong-negative"))


def correlation_findings(matrix: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` upper-triangle pairs by |r| with strength and direction."""
    up = matrix.where(F.col("i") < F.col("j")).withColumn("abs_r", F.abs("r"))
    top = top_n(up.where(F.col("r").isNotNull()), n, [F.desc("abs_r"), F.asc("i"), F.asc("j")])
    return (top.withColumn("strength", F.when(F.col("abs_r") >= 0.7, "Strong").when(F.col("abs_r") >= 0.4, "Moderate")
                           .otherwise("Weak"))
            .withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("inverse"))
            .withColumn("class", correlation_class("r")))


def trend_line(df: DataFrame, x: str, y: str, min_abs_r: float = 0.3) -> DataFrame:
    """OLS slope/intercept of y on x per device; ``draw`` when |r| > 0.3."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy("device_id").agg(
        F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"),
        safe_corr(x, y).alias("r"), F.regr_count(yc, xc).alias("n")).withColumn(
        "draw", F.coalesce(F.abs("r") > min_abs_r, F.lit(False)))


def weekly_pattern(df: DataFrame, sensor: str, ts: str = "gw_timestamp") -> DataFrame:
    """(day of week 0=Mon, hour) -> mean; all 168 cells per device, NULL when empty; min-max scaled value."""
    d = df.select("device_id", F.weekday(ts).alias("day_of_week"), F.hour(ts).alias("hour"),
                  F.col(sensor).cast("double").alias("v"))
    cells = d.groupBy("device_id", "day_of_week", "hour").agg(F.avg("v").alias("value"))
    spine = (df.select("device_id").distinct()
             .select("device_id", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("_c"))
             .select("device_id", (F.col("_c") / 24).cast("int").alias("day_of_week"),
                     (F.col("_c") % 24).cast("int").alias("hour")))
    g = spine.join(cells, ["device_id", "day_of_week", "hour"], "left")
    w = Window.partitionBy("device_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return g.withColumn("scaled", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).when(F.col("value").isNotNull(),
                                                                                          F.lit(0.0)))


def weekly_extremes(grid: DataFrame) -> DataFrame:
    """Lowest and highest cell (first in day, hour order on ties) and weekday - weekend mean of cell means."""
    v = F.col("value")
    nn = v.isNotNull()
    return grid.groupBy("device_id").agg(
        F.min(F.when(nn, F.struct(v.alias("k"), F.col("day_of_week").alias("d"), F.col("hour").alias("h")))).alias("lo"),
        F.min(F.when(nn, F.struct((-v).alias("k"), F.col("day_of_week").alias("d"), F.col("hour").alias("h"))))
        .alias("hi"),
        F.avg(F.when(F.col("day_of_week") < 5, v)).alias("weekday_avg"),
        F.avg(F.when(F.col("day_of_week") >= 5, v)).alias("weekend_avg")).select(
        "device_id", F.col("lo.d").alias("low_day"), F.col("lo.h").alias("low_hour"), F.col("lo.k").alias("low_value"),
        F.col("hi.d").alias("high_day"), F.col("hi.h").alias("high_hour"), (-F.col("hi.k")).alias("high_value"),
        "weekday_avg", "weekend_avg", (F.col("weekday_avg") - F.col("weekend_avg")).alias("weekday_minus_weekend"))


def weekly_pattern_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlay of two weekly grids (e.g. two periods) on (device, day, hour)."""
    return (a.select("device_id", "day_of_week", "hour", F.col("value").alias("value_a"))
            .join(b.select("device_id", "day_of_week", "hour", F.col("value").alias("value_b")),
                  ["device_id", "day_of_week", "hour"], "full")
            .withColumn("diff", F.col("value_a") - F.col("value_b")))


def weekly_overlay(df: DataFrame, sensor: str, period1: dict, period2: dict, bin_minutes: int = 60, ts: str = "gw_timestamp") -> DataFrame:
    """Means of two periods by (day of week, bin of ``bin_minutes`` from midnight) and their difference, from one
    scan by conditional aggregates.  Bins without readings in either period are left out."""
    def within(p):
        c = F.lit(True)
        if p.get("start") is not None:
            c = c & (F.col(ts) >= F.lit(p["start"]).cast("timestamp_ntz"))
        return c if p.get("end") is None else c & (F.col(ts) < F.lit(p["end"]).cast("timestamp_ntz"))

    minute = F.hour(ts) * 60 + F.minute(ts)
    v = F.col(sensor).cast("double")
    g = df.where((within(period1) | within(period2)) & v.isNotNull()).groupBy(
        "device_id", F.weekday(ts).alias("day_of_week"), (F.floor(minute / bin_minutes) * bin_minutes).cast("int").alias("minute")).agg(
        F.avg(F.when(within(period1), v)).alias("value_a"), F.avg(F.when(within(period2), v)).alias("value_b"))
    return g.withColumn("diff", F.col("value_a") - F.col("value_b"))


def weekend_mornings(df: DataFrame, sensor: str, hours: tuple[int, int] = (6, 11), ts: str = "gw_timestamp") -> DataFrame:
    """Mean of a sensor in the morning hours ``[from, to)`` of weekends and of weekdays, and their offset."""
    v = F.col(sensor).cast("double")
    g = df.where((F.hour(ts) >= hours[0]) & (F.hour(ts) < hours[1])).groupBy("device_id").agg(
        F.avg(F.when(F.weekday(ts) >= 5, v)).alias("weekend_mean"), F.avg(F.when(F.weekday(ts) < 5, v)).alias("weekday_mean"))
    return g.withColumn("weekend_offset", F.col("weekend_mean") - F.col("weekday_mean"))


def weekly_blocks(df: DataFrame, sensor: str, block_hours: int = 2, ts: str = "gw_timestamp") -> DataFrame:
    """Means by (weekday/weekend, block of hours); flags the lowest and highest block per device."""
    d = df.select("device_id", F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday").alias("day_group"),
                  (F.floor(F.hour(ts) / block_hours) * block_hours).cast("int").alias("block_start"),
                  F.col(sensor).cast("double").alias("v"))
    g = d.groupBy("device_id", "day_group", "block_start").agg(F.avg("v").alias("value"))
    w = Window.partitionBy("device_id")
    return (g.withColumn("is_lowest", F.col("value") == F.min("value").over(w))
            .withColumn("is_highest", F.col("value") == F.max("value").over(w)))


def calendar_month(df: DataFrame, sensor: str, year: int | None = None, month: int | None = None,
                   ts: str = "gw_timestamp") -> DataFrame:
    """Per day of a month: avg, min, max, std, count of non-NULL values, plus the month's min/max.

    Without ``year``/``month`` every month is computed (keyed by ``month``).
    """
    v = F.col(sensor).cast("double")
    d = df.where(v.isNotNull()).select("device_id", month_str(ts).alias("month"),
                                       F.dayofmonth(ts).alias("day"), v.alias("v"))
    if year is not None and month is not None:
        d = d.where(F.col("month") == f"{year:04d}-{month:02d}")
    days = d.groupBy("device_id", "month", "day").agg(
        F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("device_id", "month")
    return days.withColumn("month_min", F.min("min").over(w)).withColumn("month_max", F.max("max").over(w))


def day_extremes(df: DataFrame, sensor: str, ts: str = "gw_timestamp") -> DataFrame:
    """Per day: time of the lowest and highest value (first on ties) and the range."""
    v = F.col(sensor).cast("double")
    nn = v.isNotNull()
    return (df.groupBy("device_id", F.to_date(ts).alias("date")).agg(
        F.min(F.when(nn, F.struct(v.alias("k"), F.col(ts).alias("t")))).alias("lo"),
        F.min(F.when(nn, F.struct((-v).alias("k"), F.col(ts).alias("t")))).alias("hi"))
        .where(F.col("lo").isNotNull())
        .select("device_id", "date", F.col("lo.t").alias("min_time"), F.col("lo.k").alias("min_value"),
                F.col("hi.t").alias("max_time"), (-F.col("hi.k")).alias("max_value"),
                (-F.col("hi.k") - F.col("lo.k")).alias("range")))


def day_hourly(df: DataFrame, sensor: str, day=None, ts: str = "gw_timestamp") -> DataFrame:
    """24 hourly means per day (NULL when the hour has no rows); every day, or one ``day``."""
    d = df.select("device_id", F.to_date(ts).alias("date"), F.hour(ts).alias("hour"),
                  F.col(sensor).cast("double").alias("v"))
    if day is not None:
        d = d.where(F.col("date") == F.lit(day).cast("date"))
    means = d.groupBy("device_id", "date", "hour").agg(F.avg("v").alias("value"))
    spine = (d.select("device_id", "date").distinct()
             .select("device_id", "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")))
    return spine.join(means, ["device_id", "date", "hour"], "left")


def daily_aggregates_by_hour(df: DataFrame, sensor: str, ts: str = "gw_timestamp", date: str | None = None) -> DataFrame:
    """Hours of each day -> avg, min, max, std, count of one sensor; of one day only with ``date`` (ISO), whose
    bounds are pushed down to the scan."""
    v = F.col(sensor).cast("double")
    if date is not None:
        day = dt.date.fromisoformat(date)
        df = time_range(df, {"start": day.isoformat(), "end": (day + dt.timedelta(days=1)).isoformat()}, ts_col=ts)
    return df.groupBy("device_id", F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(
        F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"),
        F.count(v).alias("count"))


def data_quality_metrics(df: DataFrame, expected_per_day: int = 2880, sensor: str = "temperature_sht",
                         ts: str = "gw_timestamp") -> DataFrame:
    """Per day between a device's first and last one: missing share against the expected cadence (a day
    without rows: 100), and drift = daily median minus the median of the previous 7 daily medians."""
    d = df.groupBy("device_id", F.to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), pct(sensor, 0.5).alias("daily_median"))
    # the next day with rows, found on day rows; the days up to it are empty
    after = F.lead("date").over(Window.partitionBy("device_id").orderBy("date"))
    real = F.col("_day") == F.col("date")
    d = d.withColumn("_to", after).withColumn("_day", F.explode(F.sequence("date", F.coalesce(F.date_sub("_to", 1), F.col("date")))))
    d = d.select("device_id", F.col("_day").alias("date"), F.when(real, F.col("rows")).otherwise(0).alias("rows"),
                 F.when(real, F.col("daily_median")).alias("daily_median"))
    w = Window.partitionBy("device_id").orderBy(F.unix_date("date")).rangeBetween(-7, -1)
    trailing = F.percentile(F.col("daily_median"), 0.5).over(w)
    return (d.withColumn("missing_pct", F.greatest(F.lit(0.0), 1 - F.col("rows") / float(expected_per_day)) * 100)
            .withColumn("drift", F.col("daily_median") - trailing))


def custom_agg(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """User-chosen aggregate expressions over user-chosen keys (always including the device)."""
    keys = ["device_id"] + [k for k in keys if k != "device_id"]
    return df.groupBy(*keys).agg(*aggs)


def scatter_sample(df: DataFrame, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per device with both values present, chosen by a seeded hash of device and time
    (reproducible, and the same in any engine with MD5)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        "device_id", "gw_timestamp", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "device_id", epoch_micros("gw_timestamp"))))
    return top_n(d, n, [F.asc("_h"), F.asc("gw_timestamp"), F.asc("x"), F.asc("y")]).drop("_h")


def lag_matrix(hourly_long: DataFrame, lags=range(-12, 13), block_hours: int = 240) -> DataFrame:
    """corr(x[t], y[t + k]) for every ordered sensor pair and lag on long hourly rows (hour_ts, sensor, value).

    Halo-blocked: the hours of a device and sensor become a dense array per block of ``block_hours``, with as
    many hours of the neighbouring blocks at either end as the largest lag needs.  Every pair and lag is then a
    pair of slices of one block's arrays, so what is shuffled does not grow with the number of lags.
    """
    lags = [int(k) for k in lags]
    halo = max((abs(k) for k in lags), default=0)
    size = max(block_hours, halo, 1)
    hour = F.floor(epoch_micros("hour_ts") / 3_600_000_000)
    rows = hourly_long.select("device_id", "sensor", F.col("value").cast("double").alias("value"), hour.alias("_h"))
    own = F.floor(F.col("_h") / size)
    place = F.col("_h") - own * size
    blocks = F.array_compact(F.array(own, F.when(place < halo, own - 1), F.when(place >= size - halo, own + 1)))
    rows = rows.select("device_id", "sensor", "value", "_h", F.explode(blocks).alias("_b"))
    rows = rows.withColumn("_o", (F.col("_h") - F.col("_b") * size + halo).cast("int"))
    dense = rows.groupBy("device_id", "_b", "sensor").agg(F.map_from_entries(F.collect_list(F.struct("_o", "value"))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(size + 2 * halo - 1))
    dense = dense.select("device_id", "_b", F.struct("sensor", F.transform(every, lambda i: F.element_at("_m", i)).alias("v")).alias("_s"))
    block = dense.groupBy("device_id", "_b").agg(F.collect_list("_s").alias("_s"))
    pair = (block.select("device_id", "_s", F.explode("_s").alias("_x")).select("device_id", "_x", F.explode("_s").alias("_y"))
            .select("device_id", "_x", "_y", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag_hours")))
    here = F.slice("_x.v", F.lit(halo + 1), F.lit(size))
    there = F.slice("_y.v", F.lit(halo + 1) + F.col("lag_hours"), F.lit(size))
    both = (pair.select("device_id", F.col("_x.sensor").alias("x"), F.col("_y.sensor").alias("y"), "lag_hours",
                        F.explode(F.arrays_zip(here.alias("xv"), there.alias("yv"))).alias("_v"))
            .where("_v.xv is not null and _v.yv is not null").select("device_id", "x", "y", "lag_hours", "_v.xv", "_v.yv"))
    return both.groupBy("device_id", "x", "y", "lag_hours").agg(safe_corr("xv", "yv").alias("correlation"))


def seasonal_decompose(hourly: DataFrame, col: str = "temp") -> DataFrame:
    """Additive split of an hourly series: trend = centred 24 h mean (25 rows), seasonal = mean detrended
    value by hour of week, residual = value - trend - seasonal.  Windows run over one device's hours."""
    w = Window.partitionBy("device_id").orderBy("hour_ts").rowsBetween(-12, 12)
    n = F.count("value").over(w)
    d = (hourly.select("device_id", "hour_ts", F.col(col).alias("value"))
         .withColumn("trend", F.when(n == 25, F.avg("value").over(w)))
         .withColumn("how", F.weekday("hour_ts") * 24 + F.hour("hour_ts")))
    season = (d.groupBy("device_id", "how").agg(F.avg(F.col("value") - F.col("trend")).alias("seasonal")))
    return (d.join(season, ["device_id", "how"], "left")
            .withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("how"))


def hourly_long(hourly: DataFrame, cols=("temp", "humidity", "pressure", "light", "sound")) -> DataFrame:
    sel = hourly.select("device_id", "hour_ts", *[F.col(c).cast("double").alias(c) for c in cols])
    return sel.unpivot(["device_id", "hour_ts"], list(cols), "sensor", "value").where(F.col("value").isNotNull())


def hour_bins(df: DataFrame) -> DataFrame:
    return df.withColumn("hour_ts", hour_floor("gw_timestamp"))
