"""Comfort and discomfort: per-reading scores and their hourly/daily summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions import exprs as X
from roomtrace.functions.exprs import hour_floor, pct
from roomtrace.operators.insights import insight_row, num
from roomtrace.operators.joins import join_small
from roomtrace.operators.series import top_n


def with_discomfort(loc: DataFrame) -> DataFrame:
    return loc.withColumn("discomfort", X.discomfort("temperature_sht", "humidity", "sound_level"))


def discomfort_by_hour(loc: DataFrame) -> DataFrame:
    d = with_discomfort(loc)
    return d.groupBy("device_id", "hour").agg(
        pct("discomfort", 0.95).alias("discomfort_p95"), pct("temperature_sht", 0.95).alias("temperature_p95"),
        pct("humidity", 0.05).alias("humidity_p05"), pct("sound_level", 0.95).alias("sound_p95"))


def discomfort_days(loc: DataFrame, n: int = 8) -> DataFrame:
    """Top ``n`` local days by p95 discomfort (NULLs last, earlier day first on ties)."""
    d = with_discomfort(loc)
    days = d.groupBy("device_id", "local_date").agg(
        pct("discomfort", 0.95).alias("discomfort_p95"), F.max("temperature_sht").alias("temp_max"),
        F.min("humidity").alias("humidity_min"), pct("sound_level", 0.95).alias("sound_p95"))
    return top_n(days, n, [F.col("discomfort_p95").desc_nulls_last(), F.asc("local_date")])


def comfort_timeline(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Comfort index, sub-scores, rating and heat index per reading."""
    s = X.comfort_scores("temperature_sht", "humidity", "light", "sound_level", weights)
    return df.select("device_id", "gw_timestamp", *[v.alias(k) for k, v in s.items()],
                     X.heat_index("temperature_sht", "humidity").alias("heat_index"))


def comfort_profile(df: DataFrame, profiles: DataFrame, weights: dict | None = None) -> DataFrame:
    """Comfort index per reading by each device's own ideal ranges.

    ``profiles``: a row a device with ``device_id`` and any of ``temperature_lo/_hi``, ``humidity_lo/_hi``,
    ``light_lo/_hi``, ``sound_hi``; what is missing or NULL, and devices without a row, take the defaults.
    """
    def bound(name: str, default):
        return F.coalesce(F.col(f"_p.{name}").cast("double"), F.lit(float(default))) if name in profiles.columns else F.lit(float(default))

    p = profiles.select("device_id", F.struct(*profiles.columns).alias("_p"))
    j = join_small(df, p, "device_id", "left")
    ideal = {k: (bound(f"{k}_lo", lo), bound(f"{k}_hi", hi)) for k, (lo, hi) in X.COMFORT_IDEAL.items()}
    s = X.comfort_scores("temperature_sht", "humidity", "light", "sound_level", weights, ideal)
    return j.select("device_id", "gw_timestamp", *[v.alias(k) for k, v in s.items()])


def insight_health(loc: DataFrame, hourly: DataFrame, good: float = 75, stable_hpa: float = 2.0) -> DataFrame:
    """Insight rows: the share of readings in the comfort zone, and how often pressure was stable: the share of
    hours whose median differs by at most ``stable_hpa`` from that of three hours before."""
    share = health_share(loc, good).where("pct_in_comfort_zone is not null")
    text = F.format_string("%s%% of the readings lie in the comfort zone", num("pct_in_comfort_zone", 0))
    a = insight_row(share, "health", F.when(F.col("pct_in_comfort_zone") < 50, "medium").otherwise("low"), F.lit("Time in the comfort zone"), text,
                    F.lit(None).cast("string"), F.col("pct_in_comfort_zone"))
    t = pressure_trend(hourly, 3, stable_hpa).groupBy("device_id").agg(
        (F.count_if(F.col("trend") == "stable") / F.count("trend") * 100).alias("pct")).where("pct is not null")
    steady = F.col("pct") >= 90
    b = insight_row(t, "health", F.lit("low"), F.when(steady, "Steady air pressure").otherwise("Changing air pressure"),
                    F.format_string("Pressure kept within %s hPa over three hours %s%% of the time", num(F.lit(stable_hpa)), num("pct", 0)),
                    F.lit("pressure"), F.col("pct"))
    return a.unionByName(b)


def hourly_comfort(df: DataFrame, weights: dict | None = None) -> DataFrame:
    ct = comfort_timeline(df, weights)
    return ct.groupBy("device_id", hour_floor("gw_timestamp").alias("hour_ts")).agg(
        F.avg("comfort_index").alias("comfort_index"))


def uncomfortable_hours(loc: DataFrame, threshold: float = 60, tz: str = "America/Chicago") -> DataFrame:
    """Per local day: hours whose mean comfort index is below ``threshold``."""
    h = hourly_comfort(loc).withColumn("local_date", F.to_date(X.to_local("hour_ts", tz)))
    return h.groupBy("device_id", "local_date").agg(
        F.count_if(F.col("comfort_index") < threshold).alias("uncomfortable_hours"),
        F.count("comfort_index").alias("scored_hours"))


def comfort_alerts(loc: DataFrame, threshold: float = 60) -> DataFrame:
    """Hours where the hourly comfort index falls below ``threshold`` from at/above it."""
    h = hourly_comfort(loc)
    prev = F.lag("comfort_index").over(Window.partitionBy("device_id").orderBy("hour_ts"))
    return (h.withColumn("prev_comfort_index", prev)
            .where((F.col("comfort_index") < threshold) & (F.col("prev_comfort_index") >= threshold)))


def compare_rooms(loc: DataFrame, good: float = 75) -> DataFrame:
    """Comfort by device: mean index, share of readings at or above ``good``, mean sub-scores."""
    ct = comfort_timeline(loc)
    return ct.groupBy("device_id").agg(
        F.avg("comfort_index").alias("mean_comfort"),
        (F.count_if(F.col("comfort_index") >= good) / F.count("comfort_index")).alias("share_good"),
        F.avg("temperature_score").alias("temperature_score"), F.avg("humidity_score").alias("humidity_score"),
        F.avg("light_score").alias("light_score"), F.avg("sound_score").alias("sound_score"))


# Our texts for low sub-scores (the plan shows the idea, not the words).
SUGGESTIONS = {
    "temperature_score": "Adjust the temperature toward 68-74 F",
    "humidity_score": "Bring humidity toward 40-50 %",
    "light_score": "Aim for moderate light (500-2000)",
    "sound_score": "Reduce noise",
}


def comfort_suggestions(loc: DataFrame, below: float = 80) -> DataFrame:
    """One row per device and weak sub-score (mean below ``below``) with advice text."""
    rooms = compare_rooms(loc)
    items = F.array(*[F.when(F.col(k) < below, F.struct(F.lit(k).alias("score"), F.col(k).alias("value"),
                                                        F.lit(v).alias("suggestion"))) for k, v in SUGGESTIONS.items()])
    return (rooms.select("device_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("s"))
            .select("device_id", "s.score", "s.value", "s.suggestion"))


def health_share(loc: DataFrame, good: float = 75) -> DataFrame:
    """Share of readings in the comfort zone (index >= ``good``)."""
    ct = comfort_timeline(loc)
    return ct.groupBy("device_id").agg(
        (F.count_if(F.col("comfort_index") >= good) / F.count("comfort_index") * 100).alias("pct_in_comfort_zone"))


def window_index(loc: DataFrame, hours, name: str, light_band=(0, 50), sound_max: float = 100) -> DataFrame:
    """Composite for a block of local hours: mean of temp/humidity scores and a light/sound fit score.

    Our definition for the sleep (22-6, dark and quiet) and productivity (9-17,
    bright and steady) indices that the plans name without a formula.
    """
    s = X.comfort_scores("temperature_sht", "humidity", "light", "sound_level")
    lt = F.col("light").cast("double")
    light_fit = F.when(lt.between(*light_band), 100.0).otherwise(60.0)
    sound_fit = F.when(F.col("sound_level") <= sound_max, 100.0).otherwise(60.0)
    score = s["temperature_score"] * 0.35 + s["humidity_score"] * 0.25 + light_fit * 0.2 + sound_fit * 0.2
    return (loc.where(F.col("hour").isin(list(hours)))
            .groupBy("device_id", "local_date").agg(F.avg(score).alias(name)))


def sleep_index(loc: DataFrame) -> DataFrame:
    return window_index(loc, [22, 23, 0, 1, 2, 3, 4, 5], "sleep_index", light_band=(0, 50), sound_max=100)


def productivity_index(loc: DataFrame) -> DataFrame:
    return window_index(loc, range(9, 17), "productivity_index", light_band=(500, 2000), sound_max=200)


def pressure_trend(hourly: DataFrame, hours: int = 3, threshold: float = 1.0) -> DataFrame:
    """3-hour change of the hourly median pressure: rising, falling or stable."""
    prev = F.lag("pressure", hours).over(Window.partitionBy("device_id").orderBy("hour_ts"))
    d = hourly.select("device_id", "hour_ts", "pressure").withColumn("pressure_change", F.col("pressure") - prev)
    return d.withColumn("trend", F.when(F.col("pressure_change") > threshold, "rising")
                        .when(F.col("pressure_change") < -threshold, "falling")
                        .when(F.col("pressure_change").isNotNull(), "stable"))
