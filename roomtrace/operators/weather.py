"""Outdoor weather: localisation, hourly join and the indoor/outdoor comparisons.

The weather table is hourly (its size is bounded by the hours of the
period, not by the readings), keyed by the UTC hour start.  It is joined
through ``join_small``: broadcast after a row-count check, a shuffle join
beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import EPOCH_NTZ, celsius_to_fahrenheit, pct, safe_corr
from roomtrace.operators.joins import join_small
from roomtrace.operators.series import lag_profile


def weather_prepare(weather: DataFrame) -> DataFrame:
    """Add the unrounded deg F outdoor temperature."""
    return weather.withColumn("outdoor_temp_f", celsius_to_fahrenheit("temperature_2m", None))


def join_weather(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly bins inner-joined to weather on the hour."""
    w = weather_prepare(weather).select("hour_ts", "outdoor_temp_f", "pressure_msl", "precipitation", "rain",
                                        "wind_gusts_10m")
    return join_small(hourly, w, "hour_ts")


def monthly_coupling(hw: DataFrame) -> DataFrame:
    m = hw.groupBy("device_id", F.col("local_month").alias("month")).agg(
        pct("temp", 0.5).alias("indoor_temp_f"), pct("outdoor_temp_f", 0.5).alias("outdoor_temp_f"),
        pct("pressure", 0.5).alias("indoor_pressure"), pct("pressure_msl", 0.5).alias("outdoor_pressure"),
        pct("light", 0.5).alias("indoor_light"), F.sum("precipitation").alias("precipitation_mm"))
    return (m.withColumn("temp_delta_f", F.col("indoor_temp_f") - F.col("outdoor_temp_f"))
            .withColumn("pressure_gap_hpa", F.col("indoor_pressure") - F.col("outdoor_pressure")))


def weather_daily(hw: DataFrame) -> DataFrame:
    d = hw.groupBy("device_id", F.col("local_date").alias("date")).agg(
        F.coalesce(F.sum("rain"), F.lit(0.0)).alias("rain_mm"),
        F.count_if(F.col("precipitation") > 0).alias("precip_hours"),
        F.avg("outdoor_temp_f").alias("outdoor_temp_f"), pct("temp", 0.5).alias("indoor_temp_f"),
        pct("light", 0.5).alias("indoor_light"), pct("sound", 0.5).alias("indoor_sound"),
        pct("pressure", 0.5).alias("indoor_pressure"), pct("pressure_msl", 0.5).alias("outdoor_pressure"))
    return d.withColumn("rainy", F.col("rain_mm") > 0)


def rainy_vs_dry(wd: DataFrame) -> DataFrame:
    return wd.groupBy("device_id", "rainy").agg(
        pct("indoor_light", 0.5).alias("indoor_light"), pct("indoor_sound", 0.5).alias("indoor_sound"),
        pct("indoor_temp_f", 0.5).alias("indoor_temp_f"), pct("outdoor_temp_f", 0.5).alias("outdoor_temp_f"))


def weather_compare(hw: DataFrame, wd: DataFrame) -> DataFrame:
    """One row per device: merged hours, indoor/outdoor correlations, pressure gap, rainy/dry medians."""
    h = hw.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("merged_hours"),
        safe_corr("temp", "outdoor_temp_f").alias("indoor_outdoor_temp_corr"),
        safe_corr("pressure", "pressure_msl").alias("indoor_outdoor_pressure_corr"),
        pct(F.col("pressure") - F.col("pressure_msl"), 0.5).alias("pressure_gap_median_hpa"))
    r = F.col("rainy")
    d = wd.groupBy("device_id").agg(
        pct(F.when(r, F.col("indoor_light")), 0.5).alias("rainy_day_indoor_light_median"),
        pct(F.when(~r, F.col("indoor_light")), 0.5).alias("dry_day_indoor_light_median"),
        pct(F.when(r, F.col("indoor_sound")), 0.5).alias("rainy_day_indoor_sound_median"),
        pct(F.when(~r, F.col("indoor_sound")), 0.5).alias("dry_day_indoor_sound_median"),
        F.count_if(r).alias("rainy_days"), F.count_if(~r).alias("dry_days"))
    return h.join(d, "device_id")


def outdoor_lag_profile(hw: DataFrame, lags=range(-24, 25, 2), positional: bool = False) -> DataFrame:
    """corr(outdoor[t], indoor[t + k]) over the joined hours, k = -24..24 step 2.

    By default ``k`` are hours.  ``positional`` shifts by places in the sequence of joined rows, whatever hours
    lie between them.
    """
    if positional:
        place = F.row_number().over(Window.partitionBy("device_id").orderBy("hour_ts"))  # hourly rows of a device
        hw = hw.withColumn("hour_ts", F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), place))
    return lag_profile(hw, x="outdoor_temp_f", y="temp", lags=lags)
