"""Queries over R3 (rows stored twice, equal and missing times, a trend, a weekend effect, a quiet week), and the
variants that take an argument of the user: comfort ranges, one day, bins of minutes, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtrace.functions import exprs as X
from roomtrace.operators import clean as C, comfort, grain, insights as I, quality, series, stats, weather
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, raw, register
from roomtrace.plans.catalog_anomalies import _CORR, _FINDINGS, _QW, _TREND, _TREND_ROWS, _WEEKEND, _matrix_sql, _num, _trend_lf
from roomtrace.plans.catalog_color import comfort_sql
from roomtrace.plans.catalog_profiles import _hw_sql, _lag_sql, hw
from roomtrace.plans.catalog_stats import unpivot_sql
from roomtrace.schema import CSV_FIELDNAMES

_METRIC = ("metric",)


@register("skip_malformed_r3", S.cte(raw=S.R3) + """
select device_id, count(*) as rows, count(timestamp_monotonic) as with_uptime from raw where gw_timestamp is not null group by all""", ints=("device_id",))
def q_skip_malformed_r3(spark, sf_dir):
    return C.skip_malformed(raw(spark, sf_dir, "r3")).groupBy("device_id").agg(F.count(F.lit(1)).alias("rows"), F.count("timestamp_monotonic").alias("with_uptime"))


@register("clean_audit_r3", S.cte(raw=S.R3) + """
select device_id, count(*) as source_rows, count(*) filter (where gw_timestamp is null) as invalid_gw_timestamp,
       count(*) filter (where pressure < 900) as pressure_lt_900_hpa, count(*) filter (where light > 70000) as light_gt_70000_clear_counts,
       count(*) filter (where timestamp_monotonic is null) as corrupt_monotonic_non_numeric from raw group by all""", ints=("device_id",))
def q_clean_audit_r3(spark, sf_dir):
    return C.clean_audit(raw(spark, sf_dir, "r3"))


@register("quality_flags_r3", S.cte(raw=S.R3) + f"""
select f.*, d.duplicate_rows from
(select device_id, count(*) filter (where temperature_sht < 0) as negative_temperature,
        count(*) filter (where light = 0) as zero_light, count(*) filter (where sound_level > 100) as high_sound from raw group by all) f
join (select device_id, cast(sum(c - 1) as bigint) as duplicate_rows from (
        select {', '.join(['device_id'] + CSV_FIELDNAMES)}, count(*) as c from raw group by all) x group by all) d on d.device_id = f.device_id""", ints=("device_id",))
def q_quality_flags_r3(spark, sf_dir):
    return quality.quality_flags(raw(spark, sf_dir, "r3"))


_GAPS_R3 = f"""select device_id, gw_timestamp, timestamp_monotonic,
       date_diff('microsecond', lag(gw_timestamp) over w, gw_timestamp) / 1000000.0 as gw_gap_s,
       timestamp_monotonic - lag(timestamp_monotonic) over w as mono_gap_s
from clean window w as (partition by device_id order by gw_timestamp, timestamp_monotonic nulls first)"""


@register("time_gaps_r3", S.cte(**S.base("r3"), g=_GAPS_R3) + " select device_id, gw_timestamp, timestamp_monotonic, gw_gap_s, mono_gap_s from g",
          doubles=("timestamp_monotonic", "gw_gap_s", "mono_gap_s"), ts=("gw_timestamp",), ints=("device_id",))
def q_time_gaps_r3(spark, sf_dir):
    """Equal times stand in order of uptime, missing uptimes first."""
    return series.time_gaps(clean(spark, sf_dir, "r3")).select("device_id", "gw_timestamp", "timestamp_monotonic", "gw_gap_s", "mono_gap_s")


@register("provenance_events", S.cte(**S.base("r3"), g=_GAPS_R3, e="""
select device_id, 'gap' as kind, gw_timestamp, gw_gap_s as seconds, row_number() over (partition by device_id order by gw_gap_s desc, gw_timestamp) as place
from g where gw_gap_s > 3600
union all
select device_id, 'reboot', gw_timestamp, mono_gap_s, row_number() over (partition by device_id order by gw_timestamp, mono_gap_s) from g where mono_gap_s < 0""") + """
select device_id, kind, place, gw_timestamp, case when kind = 'gap' then seconds end as gap_seconds from e
where (kind = 'gap' and place <= 8) or (kind = 'reboot' and place <= 12)""", doubles=("gap_seconds",), ts=("gw_timestamp",), ints=("device_id", "place"))
def q_provenance_events(spark, sf_dir):
    """The gaps and reboots that provenance lists (a reboot's size depends on the order of equal times)."""
    ev = quality.provenance_events(series.time_gaps(clean(spark, sf_dir, "r3")))
    return ev.select("device_id", "kind", "place", "gw_timestamp", F.when(F.col("kind") == "gap", F.col("seconds")).alias("gap_seconds"))


@register("insight_trend_r3", S.cte(**S.base("r3"), lf=_trend_lf(), tr=_TREND.replace("lf.gw_timestamp", "s.gw_timestamp")) + _TREND_ROWS,
          doubles=_METRIC, ints=("device_id",))
def q_insight_trend_r3(spark, sf_dir):
    return I.insight_trend(clean(spark, sf_dir, "r3"))


@register("insight_weekend_r3", S.cte(**S.base("r3"), wl=unpivot_sql("clean", sensors=["temperature_sht", "light", "sound_level"], nulls=False)) + _WEEKEND,
          doubles=_METRIC, ints=("device_id",))
def q_insight_weekend_r3(spark, sf_dir):
    return I.insight_weekend(clean(spark, sf_dir, "r3"))


@register("insight_correlation_r3", S.cte(**S.base("r3"), **_matrix_sql(), fnd=_FINDINGS) + _CORR, doubles=_METRIC, ints=("device_id",))
def q_insight_correlation_r3(spark, sf_dir):
    return I.insight_correlation(stats.correlation_findings(stats.correlation_matrix(clean(spark, sf_dir, "r3"))))


@register("insight_quiet_week_r3", S.cte(**S.base("r3")) + _QW, doubles=_METRIC, ints=("device_id",))
def q_insight_quiet_week_r3(spark, sf_dir):
    return I.insight_quiet_week(clean(spark, sf_dir, "r3"))


_HEALTH_CT = comfort_sql()


@register("insight_health_rows", S.cte(**S.base("r1"), h=S.hourly("clean"), share=f"""
select device_id, count(*) filter (where ci >= 75) / count(ci) * 100 as pct from (select device_id, {_HEALTH_CT['comfort_index']} as ci from loc) c group by all""", t="""
select device_id, count(*) filter (where abs(d) <= 2.0) / count(d) * 100 as pct
from (select device_id, pressure - lag(pressure, 3) over (partition by device_id order by hour_ts) as d from h) x group by all""") + f"""
select device_id, 'health' as category, case when pct < 50 then 'medium' else 'low' end as priority, 'Time in the comfort zone' as title,
       {_num('pct', 0)} || '% of the readings lie in the comfort zone' as description, cast(null as varchar) as sensor, pct as metric from share
union all
select device_id, 'health', 'low', case when pct >= 90 then 'Steady air pressure' else 'Changing air pressure' end,
       'Pressure kept within 2.0 hPa over three hours ' || {_num('pct', 0)} || '% of the time', 'pressure', pct from t""", doubles=_METRIC, ints=("device_id",))
def q_insight_health_rows(spark, sf_dir):
    return comfort.insight_health(loc(spark, sf_dir), grain.hourly_resample(clean(spark, sf_dir)))


# a profile for device 0 only; device 1 keeps the default ranges
PROFILE = {"temperature_lo": 62.0, "temperature_hi": 66.0, "humidity_lo": 20.0, "humidity_hi": 30.0, "sound_hi": 150.0}


def _profile_sql() -> str:
    t, h, lt, s = "temperature_sht", "humidity", "cast(light as double)", "cast(sound_level as double)"
    ts = f"(case when {t} between tl and th then 100.0 when {t} between tl - 3 and th + 3 then 80.0 when {t} between tl - 8 and th + 6 then 60.0 else greatest(0.0, 100 - abs({t} - (tl + th) / 2) * 5) end)"
    hs = f"(case when {h} between hl and hh then 100.0 when {h} between hl - 5 and hh + 5 then 80.0 when {h} between hl - 10 and hh + 10 then 60.0 else greatest(0.0, 100 - abs({h} - (hl + hh) / 2) * 3) end)"
    ls = f"(case when {lt} between 500 and 2000 then 100.0 when {lt} between 200 and 3000 then 80.0 else 60.0 end)"
    ss = f"(case when {s} < sh then 100.0 when {s} < sh + 100 then 80.0 when {s} < sh + 300 then 60.0 else greatest(0.0, 100 - ({s} - (sh + 300)) / 5) end)"
    w = X.COMFORT_WEIGHTS
    index = f"round_even({ts} * {w['temperature']} + {hs} * {w['humidity']} + {ls} * {w['light']} + {ss} * {w['sound']}, 1)"
    own = {"tl": ("temperature_lo", 68), "th": ("temperature_hi", 74), "hl": ("humidity_lo", 40), "hh": ("humidity_hi", 50), "sh": ("sound_hi", 100)}
    cols = ", ".join(f"case when device_id = 0 then {PROFILE[k]} else {float(d)} end as {c}" for c, (k, d) in own.items())
    return f"""select device_id, gw_timestamp, case when {t} is not null then round_even({ts}, 1) end as temperature_score,
       case when {t} is not null and {h} is not null and {lt} is not null and {s} is not null then {index} end as comfort_index
from (select *, {cols} from loc) l"""


@register("comfort_ranges", S.cte(**S.base("r1")) + _profile_sql(), doubles=("temperature_score", "comfort_index"), ts=("gw_timestamp",), ints=("device_id",))
def q_comfort_ranges(spark, sf_dir):
    """Comfort by ideal ranges that the user of device 0 has chosen."""
    table = spark.range(1).select(F.col("id").cast("int").alias("device_id"), *[F.lit(v).alias(k) for k, v in PROFILE.items()])
    return comfort.comfort_profile(loc(spark, sf_dir), table).select("device_id", "gw_timestamp", "temperature_score", "comfort_index")


@register("daily_aggregates_one_day", S.cte(**S.base("r1")) + """
select device_id, cast(gw_timestamp as date) as date, hour(gw_timestamp) as hour, avg(temperature_sht) as avg, min(temperature_sht) as min,
       max(temperature_sht) as max, stddev_samp(temperature_sht) as std, count(temperature_sht) as count
from clean where cast(gw_timestamp as date) = date '2024-01-10' group by all""", doubles=("avg", "min", "max", "std"), dates=("date",), ints=("device_id", "hour"))
def q_daily_aggregates_one_day(spark, sf_dir):
    return stats.daily_aggregates_by_hour(clean(spark, sf_dir), "temperature_sht", date="2024-01-10")


_HALVES = ({"start": None, "end": "2024-01-16 00:00:00"}, {"start": "2024-01-16 00:00:00", "end": None})


@register("weekly_overlay", S.cte(**S.base("r1")) + """
select *, value_a - value_b as diff from (
  select device_id, isodow(gw_timestamp) - 1 as day_of_week, cast(floor((hour(gw_timestamp) * 60 + minute(gw_timestamp)) / 30) * 30 as int) as minute,
         avg(temperature_sht) filter (where gw_timestamp < timestamp '2024-01-16') as value_a,
         avg(temperature_sht) filter (where gw_timestamp >= timestamp '2024-01-16') as value_b
  from clean where temperature_sht is not null group by all) g""", doubles=("value_a", "value_b", "diff"), ints=("device_id", "day_of_week", "minute"))
def q_weekly_overlay(spark, sf_dir):
    """Two halves of the month on a weekly grid of half hours."""
    return stats.weekly_overlay(clean(spark, sf_dir), "temperature_sht", *_HALVES, bin_minutes=30)


@register("weekend_mornings", S.cte(**S.base("r3")) + """
select *, weekend_mean - weekday_mean as weekend_offset from (
  select device_id, avg(cast(light as double)) filter (where isodow(gw_timestamp) >= 6) as weekend_mean,
         avg(cast(light as double)) filter (where isodow(gw_timestamp) < 6) as weekday_mean
  from clean where hour(gw_timestamp) >= 6 and hour(gw_timestamp) < 11 group by all) g""", doubles=("weekend_mean", "weekday_mean", "weekend_offset"), ints=("device_id",))
def q_weekend_mornings(spark, sf_dir):
    return stats.weekend_mornings(clean(spark, sf_dir, "r3"), "light")


@register("outdoor_lag_positional", S.cte(**_hw_sql(), p="""
select device_id, timestamp '1970-01-01' + to_hours(cast(row_number() over (partition by device_id order by hour_ts) as int)) as hour_ts, outdoor_temp_f, temp
from (select * from hw where day(hour_ts) % 3 <> 0) x""") + _lag_sql("p", "outdoor_temp_f", "temp", range(-24, 25, 2)),
          doubles=("correlation",), ints=("device_id", "lag_hours"))
def q_outdoor_lag_positional(spark, sf_dir):
    """Shifts by places over joined rows with days missing in between."""
    return weather.outdoor_lag_profile(hw(spark, sf_dir).where("day(hour_ts) % 3 <> 0"), positional=True)
