"""The offline analysis job: every section of the analysis payload from one readings table.

``cleaned`` (masked, localised) and ``hourly`` (with the empty-hour spine) are
the two shared frames.  On a cluster they are cut from their lineage by writing
them as Parquet tables into the shared folder named by ``spark.checkpoint.dir``
(survives executor loss; never ``localCheckpoint``), so the ~30 section plans
below reuse them instead of re-deriving them from the raw table.  Each section
stays a lazy DataFrame; ``run`` writes them with ``sink_sections``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from roomtrace.functions.timefn import localize
from roomtrace.operators import color, comfort, grain, insights, profiles, quality, series, weather
from roomtrace.operators.clean import clean_mask, coerce_numeric, infer_utc_offset, offset_frame, skip_malformed
from roomtrace.schema import DEFAULT_TZ
from roomtrace.session import checkpoint_dir


def materialize(df: DataFrame, cut: bool) -> DataFrame:
    """Cut lineage when ``cut`` (cluster runs): write ``df`` as a Parquet table under the shared
    checkpoint folder and read it back.

    Unlike ``checkpoint()`` (serialized rows), each section's re-read of the table keeps column
    pruning and filter pushdown; the files sit on shared storage, so an executor loss re-reads them
    instead of replaying the raw scan and the shuffles.
    """
    if not cut:
        return df
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/roomtrace-frames/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def offset_sections(readings: DataFrame) -> dict[str, DataFrame]:
    """The five fixed-offset sections plus metadata (inferred fixed offset, ``clean_drop``)."""
    ra = offset_frame(readings)
    return {
        "workday_pulse": profiles.workday_pulse(ra),
        "seasonal_light": profiles.seasonal_light(ra),
        "thermal_profile": profiles.thermal_profile(ra),
        "sound_floor": profiles.sound_floor(ra),
        "monthly_colors": profiles.monthly_top_color(ra),
        "meta": profiles.dataset_meta(ra),
        "inferred_offset": infer_utc_offset(skip_malformed(readings)),
    }


def build_sections(readings: DataFrame, weather_hourly: DataFrame | None = None, tz: str = DEFAULT_TZ,
                   cut_lineage: bool = False) -> dict[str, DataFrame]:
    """All dashboard sections keyed by name (weather sections only when weather is given)."""
    cleaned = materialize(localize(clean_mask(readings), tz), cut_lineage)
    hourly = materialize(grain.hourly_resample(cleaned, tz), cut_lineage)
    days = profiles.light_days(cleaned)
    monthly = profiles.monthly_light(days)
    classes = profiles.activity_class(profiles.daily_activity(cleaned))
    profile = profiles.activity_profile(cleaned, classes)
    lag = series.lag_profile(hourly)
    best = series.best_lag(lag)
    gaps = series.time_gaps(cleaned)
    scored = series.anomaly_score(hourly)
    eps = series.episode_labels(series.episodes(scored), weather_hourly)
    daily = grain.daily_resample(cleaned)
    pcorr = profiles.pressure_corr(daily)
    dbh = comfort.discomfort_by_hour(cleaned)
    out = {
        "seasonal_light": monthly,
        "light_shift": profiles.light_shift(monthly),
        "activity_profile": profile,
        "activity_class_counts": profiles.activity_class_counts(classes),
        "lag_profile": lag,
        "typical_day": profiles.typical_day(cleaned),
        "color_modes": color.monthly_color_modes(color.color_frame(cleaned)),
        "discomfort_by_hour": dbh,
        "discomfort_days": comfort.discomfort_days(cleaned),
        "anomaly_events": series.top_episodes(eps),
        "routine": profiles.routine_by_month(hourly),
        "pressure_monthly": profiles.pressure_monthly(daily),
        "pressure_corr": pcorr,
        "kpis": series.kpis(gaps),
        "major_gaps": series.top_gaps(gaps),
        "device_reboots": series.device_reboots(gaps),
        "schema": quality.column_summary(coerce_numeric(readings)),
        "provenance": quality.provenance_record(readings, cleaned, gaps, tz),
    }
    wcmp = obest = None
    if weather_hourly is not None:
        hw = weather.join_weather(hourly, weather_hourly)
        wd = weather.weather_daily(hw)
        wcmp = weather.weather_compare(hw, wd)
        olag = weather.outdoor_lag_profile(hw)
        obest = series.best_lag(olag)
        out.update({"monthly_coupling": weather.monthly_coupling(hw), "weather_compare": wcmp,
                    "outdoor_lag_profile": olag})
    devices = cleaned.select("device_id").distinct()
    out["insights"] = insights.insight_sections(devices, profiles.light_shift(monthly), profile, best, dbh, pcorr,
                                                wcmp, obest)
    return out


def section_sentences(readings: DataFrame, weather_hourly: DataFrame | None = None,
                      tz: str = DEFAULT_TZ, cut_lineage: bool = False) -> DataFrame:
    """Only the inputs of the nine sentences (what ``build_sections(...)["insights"]`` returns)."""
    cleaned = materialize(localize(clean_mask(readings), tz), cut_lineage)
    hourly = materialize(grain.hourly_resample(cleaned, tz), cut_lineage)
    monthly = profiles.monthly_light(profiles.light_days(cleaned))
    profile = profiles.activity_profile(cleaned, profiles.activity_class(profiles.daily_activity(cleaned)))
    best = series.best_lag(series.lag_profile(hourly))
    pcorr = profiles.pressure_corr(grain.daily_resample(cleaned))
    wcmp = obest = None
    if weather_hourly is not None:
        hw = weather.join_weather(hourly, weather_hourly)
        wcmp = weather.weather_compare(hw, weather.weather_daily(hw))
        obest = series.best_lag(weather.outdoor_lag_profile(hw))
    return insights.insight_sections(cleaned.select("device_id").distinct(), profiles.light_shift(monthly), profile,
                                     best, comfort.discomfort_by_hour(cleaned), pcorr, wcmp, obest)


def run(spark: SparkSession, readings: DataFrame, out_dir: str, weather_hourly: DataFrame | None = None,
        tz: str = DEFAULT_TZ, cut_lineage: bool = True) -> str:
    """Build and write every section (one JSON dataset per section)."""
    from roomtrace.sources.sinks import sink_sections

    secs = build_sections(readings, weather_hourly, tz, cut_lineage)
    secs.update({f"offset_{k}": v for k, v in offset_sections(readings).items()})
    return sink_sections(secs, out_dir)
