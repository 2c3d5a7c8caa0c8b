"""Profile aggregates: daily rhythm, seasonal light, activity classes, routine.

Every aggregate is keyed by ``device_id`` first.  Percentiles are exact
(``percentile`` keeps a value->count map per group, so its memory is bounded
by the distinct sensor values of a group, not its row count, and it merges
partially before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import first_max, hour_float, month_str, pct, safe_corr, seconds_between, to_local
from roomtrace.operators.joins import join_small

# ---------------------------------------------------------------------------
# fixed-offset sections (frame from ``clean.offset_frame``: local_time, hour, month, date)
# ---------------------------------------------------------------------------


def workday_pulse(df: DataFrame) -> DataFrame:
    """hour -> median and std of sound, median light."""
    return df.groupBy("device_id", "hour").agg(
        pct("sound_level", 0.5).alias("sound_median"),
        F.stddev_samp("sound_level").alias("sound_std"),
        pct("light", 0.5).alias("light_median"))


def seasonal_light(df: DataFrame, min_max_light: float = 10) -> DataFrame:
    """Per day with max light > 10: hour of the first brightest reading; median per month."""
    days = (df.groupBy("device_id", "date")
            .agg(F.max("light").alias("mx"), first_max("light", "local_time").alias("pk"))
            .where(F.col("mx") > min_max_light))
    return (days.select("device_id", month_str("pk.o").alias("month"), hour_float("pk.o").alias("peak_hour"))
            .groupBy("device_id", "month").agg(pct("peak_hour", 0.5).alias("peak_hour")))


def thermal_profile(df: DataFrame) -> DataFrame:
    """hour -> mean temperature."""
    return df.groupBy("device_id", "hour").agg(F.avg("temperature_sht").alias("temperature_sht"))


def sound_floor(df: DataFrame) -> DataFrame:
    """month -> 10th percentile of sound."""
    return df.groupBy("device_id", "month").agg(pct("sound_level", 0.1).alias("sound_floor"))


def monthly_top_color(df: DataFrame, exclude: str = "#000000") -> DataFrame:
    """month -> most frequent color other than black (smallest text on ties); black if none."""
    # one aggregation of the raw rows keeps every (device, month); excluded colors only drop out
    # of the second, small aggregation over the counts
    counts = df.groupBy("device_id", "month", "color_hex").count()
    ok = F.col("color_hex").isNotNull() & (F.col("color_hex") != exclude)
    return (counts.groupBy("device_id", "month")
            .agg(F.min(F.when(ok, F.struct((-F.col("count")).alias("k"), F.col("color_hex").alias("c")))).alias("t"))
            .select("device_id", "month", F.coalesce(F.col("t.c"), F.lit(exclude)).alias("color_hex")))


def dataset_meta(df: DataFrame) -> DataFrame:
    """row count, first/last local time, inferred offset."""
    return df.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("local_time").alias("start_date"),
        F.max("local_time").alias("end_date"), F.first("inferred_offset").alias("inferred_offset"))


# ---------------------------------------------------------------------------
# dashboard sections (frame from ``clean_mask`` + ``localize``)
# ---------------------------------------------------------------------------


def light_days(loc: DataFrame, min_samples: int = 50, min_p95: float = 100) -> DataFrame:
    """Per local day with >= 50 light rows and p95 >= 100: peak hour/light, bright window (>= p90).

    Day statistics are one row per device-day; they are joined back to the
    light rows (size-checked broadcast, else a shuffle join on the day key) and
    the bright rows are aggregated on the day's columns to find the first and
    last bright instant, so the day statistics are computed once.
    """
    lit = loc.where(F.col("light").isNotNull())
    day = (lit.groupBy("device_id", "local_date")
           .agg(F.count("light").alias("n"), pct("light", 0.95).alias("p95"), pct("light", 0.9).alias("p90"),
                first_max("light", "gw_timestamp").alias("pk"))
           .where((F.col("n") >= min_samples) & (F.col("p95") >= min_p95)))
    bright = (join_small(lit.select("device_id", "local_date", "light", "gw_timestamp"), day,
                         ["device_id", "local_date"])
              .where(F.col("light") >= F.col("p90"))
              .groupBy(*day.columns)
              .agg(F.min("gw_timestamp").alias("b0"), F.max("gw_timestamp").alias("b1")))
    return (bright
            .select("device_id", F.col("local_date").alias("date"), month_str("local_date").alias("month"),
                    hour_float(to_local("pk.o")).alias("peak_hour"), F.col("pk.v").cast("double").alias("peak_light"),
                    hour_float(to_local("b0")).alias("bright_start"), hour_float(to_local("b1")).alias("bright_end"),
                    (seconds_between("b1", "b0") / 3600.0).alias("bright_span_h")))


def monthly_light(days: DataFrame) -> DataFrame:
    """month -> medians of peak hour, bright span, peak light; number of days."""
    return days.groupBy("device_id", "month").agg(
        pct("peak_hour", 0.5).alias("peak_hour"), pct("bright_span_h", 0.5).alias("bright_span_h"),
        pct("peak_light", 0.5).alias("peak_light"), F.count("date").alias("days"))


def light_shift(monthly: DataFrame) -> DataFrame:
    """Headline: spread of the monthly peak hour (max - min), with its earliest/latest month values."""
    return monthly.groupBy("device_id").agg(
        (F.max("peak_hour") - F.min("peak_hour")).alias("peak_shift_hours"),
        F.min("peak_hour").alias("earliest_peak_hour"), F.max("peak_hour").alias("latest_peak_hour"))


def daily_activity(loc: DataFrame) -> DataFrame:
    """local day -> p75/p90 of light and sound, row count."""
    return loc.groupBy("device_id", "local_date").agg(
        pct("light", 0.75).alias("light_p75"), pct("sound_level", 0.75).alias("sound_p75"),
        pct("light", 0.9).alias("light_p90"), pct("sound_level", 0.9).alias("sound_p90"),
        F.count(F.lit(1)).alias("rows"))


def percent_rank_avg(col: str, part=("device_id",)) -> F.Column:
    """pandas ``rank(pct=True)``: average rank of ties / non-NULL count; NULL stays NULL."""
    v = F.col(col)
    w = Window.partitionBy(*part).orderBy(v.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, col))
    n = F.count(v).over(Window.partitionBy(*part))
    return F.when(v.isNotNull(), (F.rank().over(w) + (ties - 1) / 2.0) / n)


def activity_class(days: DataFrame) -> DataFrame:
    """Mean of the light and sound p75 ranks; >= Q3 active, <= Q1 quiet, else middle.

    Windows are over one device's days (a few hundred rows per device-year).
    """
    ranked = (days.withColumn("light_rank", percent_rank_avg("light_p75"))
              .withColumn("sound_rank", percent_rank_avg("sound_p75"))
              .withColumn("activity_score", (F.col("light_rank") + F.col("sound_rank")) / 2.0))
    w = Window.partitionBy("device_id")
    s = F.col("activity_score")
    return (ranked.withColumns({"q1": pct("activity_score", 0.25).over(w), "q3": pct("activity_score", 0.75).over(w)})
            .withColumn("activity_class", F.when(s >= F.col("q3"), "active").when(s <= F.col("q1"), "quiet")
                        .otherwise("middle"))
            .drop("q1", "q3"))


def activity_class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("device_id", "activity_class").agg(F.count(F.lit(1)).alias("days"))


def device_hours(df: DataFrame, n: int = 24, name: str = "hour") -> DataFrame:
    """(device_id, 0..n-1) spine without a cross join: one exploded sequence per device."""
    return df.select("device_id").distinct().select("device_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
                                                    .alias(name))


def activity_profile(loc: DataFrame, classes: DataFrame, labels=("quiet", "active")) -> DataFrame:
    """24 rows per device: median light, sound, temp per hour for quiet and active days.

    Conditional percentiles in one aggregate (what ``pivot`` compiles to).
    """
    j = join_small(loc, classes.select("device_id", "local_date", "activity_class"), ["device_id", "local_date"], "left")
    aggs = []
    for lab in labels:
        on = F.col("activity_class") == lab
        aggs += [pct(F.when(on, F.col("light")), 0.5).alias(f"{lab}_light"),
                 pct(F.when(on, F.col("sound_level")), 0.5).alias(f"{lab}_sound"),
                 pct(F.when(on, F.col("temperature_sht")), 0.5).alias(f"{lab}_temp")]
    prof = j.groupBy("device_id", "hour").agg(*aggs)
    return device_hours(loc).join(prof, ["device_id", "hour"], "left")


def typical_day(loc: DataFrame) -> DataFrame:
    return loc.groupBy("device_id", "hour").agg(pct("light", 0.5).alias("light_median"),
                                                pct("temperature_sht", 0.5).alias("temp_median"))


def routine_by_month(hourly: DataFrame, light_on: float = 300, sound_on: float = 20) -> DataFrame:
    """Over all hourly bins (empty ones count as inactive): active hours/day and medians."""
    active = F.coalesce(F.col("light") > light_on, F.lit(False)) | F.coalesce(F.col("sound") > sound_on, F.lit(False))
    return hourly.groupBy("device_id", F.col("local_month").alias("month")).agg(
        (F.avg(active.cast("int")) * 24).alias("active_hours_per_day"),
        pct("light", 0.5).alias("light_median"), pct("sound", 0.75).alias("sound_p75"),
        pct("temp", 0.5).alias("temp_median"), F.count_if(F.col("rows") > 0).alias("sampled_hours"))


def pressure_corr(daily: DataFrame) -> DataFrame:
    """Daily correlation of pressure with each daily sensor median (long form)."""
    sensors = ["pressure", "temp", "humidity", "light", "sound"]
    wide = daily.groupBy("device_id").agg(*[safe_corr("pressure", s).alias(s) for s in sensors])
    return (wide.unpivot("device_id", sensors, "sensor", "r"))


def pressure_monthly(daily: DataFrame) -> DataFrame:
    return (daily.groupBy("device_id", month_str("local_date").alias("month"))
            .agg(pct("pressure", 0.5).alias("pressure")))


def template_kpis(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Median of the 24 hourly mean temperatures; dropped = raw rows - kept rows.  One read of each input:
    the rows kept are summed from the hourly aggregate."""
    hours = kept.groupBy("device_id", "hour").agg(F.avg("temperature_sht").alias("t"), F.count(F.lit(1)).alias("n"))
    med = hours.groupBy("device_id").agg(pct("t", 0.5).alias("median_hourly_temp"), F.sum("n").alias("kept_rows"))
    return (med.join(raw.groupBy("device_id").agg(F.count(F.lit(1)).alias("raw_rows")), "device_id")
            .select("device_id", "median_hourly_temp", "raw_rows", "kept_rows", (F.col("raw_rows") - F.col("kept_rows")).alias("dropped_rows")))
