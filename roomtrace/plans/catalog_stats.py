"""Queries: statistics cards, correlation, heat maps, calendar, rollups, downsampling."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from roomtrace.functions.exprs import hour_floor
from roomtrace.functions.timefn import time_range
from roomtrace.operators import grain, stats
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, register
from roomtrace.plans.catalog_profiles import sc, us
from roomtrace.schema import NUMERIC_SENSORS
from roomtrace.session import checkpoint_dir
from roomtrace.sources import rollups
from roomtrace.streaming.live import live_rollup


def unpivot_sql(src: str, sensors=NUMERIC_SENSORS, keep=("device_id", "gw_timestamp"), nulls: bool = True) -> str:
    k = ", ".join(keep)
    parts = [f"select {k}, '{s}' as sensor, cast({s} as double) as value from {src}"
             + ("" if nulls else f" where {s} is not null") for s in sensors]
    return "\nunion all ".join(parts)


_STATS = f"""select device_id, sensor, count(*) as count, count(*) - count(value) as missing_count,
       (count(*) - count(value)) / count(*) * 100.0 as missing_percent, min(value) as min, max(value) as max,
       avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_samp(value) as std_dev,
       quantile_cont(value, 0.25) as percentile_25, quantile_cont(value, 0.75) as percentile_75,
       quantile_cont(value, 0.95) as percentile_95,
       first(gw_timestamp order by value, gw_timestamp) filter (where value is not null) as min_timestamp,
       first(gw_timestamp order by value desc, gw_timestamp) filter (where value is not null) as max_timestamp,
       {us('max(gw_timestamp)', 'min(gw_timestamp)')} / 3600.0 as time_span_hours
from lf group by all"""
_STATS_D = ("missing_percent", "min", "max", "mean", "median", "std_dev", "percentile_25", "percentile_75",
            "percentile_95", "time_span_hours")


@register("statistics", S.cte(**S.base("r1"), lf=unpivot_sql("clean"), st=_STATS) + " select * from st",
          doubles=_STATS_D, ts=("min_timestamp", "max_timestamp"), ints=("device_id",))
def q_statistics(spark, sf_dir):
    return stats.statistics(clean(spark, sf_dir))


@register("coef_variation", S.cte(**S.base("r1"), lf=unpivot_sql("clean"), st=_STATS) + """
, cv as (select device_id, sensor, case when mean > 0 then std_dev / mean * 100.0 end as cv from st)
select cv.*, coalesce(cv.sensor = b.best, false) as most_stable from cv
left join (select device_id, first(sensor order by cv, sensor) as best from cv
           where sensor in ('temperature_sht', 'humidity', 'pressure') and cv is not null group by all) b
  on b.device_id = cv.device_id""", doubles=("cv",), ints=("device_id",))
def q_coef_variation(spark, sf_dir):
    return stats.coef_variation(stats.statistics(clean(spark, sf_dir)))


@register("histogram", S.cte(**S.base("r1"), d="select device_id, cast(light as double) as v from clean where light is not null",
                             r="select device_id, min(v) as lo, max(v) as hi from d group by all",
                             b="""select d.device_id, cast(case when hi = lo then 1
                                  else least(floor((v - lo) / (hi - lo) * 20) + 1, 20) end as int) as bucket, lo, hi
                                  from d join r on r.device_id = d.device_id""") + """
select device_id, 'light' as sensor, bucket, lo + (bucket - 1) * (hi - lo) / 20 as bin_start,
       lo + bucket * (hi - lo) / 20 as bin_end, count(*) as count from b group by device_id, bucket, lo, hi""",
          doubles=("bin_start", "bin_end"), ints=("device_id", "bucket"))
def q_histogram(spark, sf_dir):
    return stats.histogram(clean(spark, sf_dir), "light")


def _matrix_sql():
    ss = NUMERIC_SENSORS
    pairs = [(a, b) for i, a in enumerate(ss) for b in ss[i:]]
    wide = "select device_id, " + ", ".join(f'{sc(a, b)} as "{a}|{b}"' for a, b in pairs) + " from clean group by all"
    cells = []
    for i, a in enumerate(ss):
        for j, b in enumerate(ss):
            key = f"{a}|{b}" if i <= j else f"{b}|{a}"
            cells.append(f"select device_id, {i} as i, {j} as j, '{a}' as x, '{b}' as y, \"{key}\" as r from w")
    return {"w": wide, "m": "\nunion all ".join(cells)}


def _class_sql(r="r"):
    return (f"case when abs({r} - 1.0) < 0.01 then 'perfect' when {r} >= 0.7 then 'strong-positive' "
            f"when {r} >= 0.4 then 'moderate-positive' when {r} >= -0.1 then 'weak-positive' "
            f"when {r} >= -0.4 then 'weak-negative' when {r} >= -0.7 then 'moderate-negative' "
            f"when {r} is not null then 'strong-negative' end")


@register("correlation_matrix", S.cte(**S.base("r1"), **_matrix_sql()) + " select * from m",
          doubles=("r",), ints=("device_id", "i", "j"))
def q_correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(clean(spark, sf_dir))


_FINDINGS = f"""select *, case when abs_r >= 0.7 then 'Strong' when abs_r >= 0.4 then 'Moderate' else 'Weak' end as strength,
       case when r > 0 then 'positive' else 'inverse' end as direction, {_class_sql()} as class
from (select *, abs(r) as abs_r from m where i < j and r is not null) u
qualify row_number() over (partition by device_id order by abs_r desc, i, j) <= 3"""


@register("correlation_findings", S.cte(**S.base("r1"), **_matrix_sql()) + _FINDINGS,
          doubles=("r", "abs_r"), ints=("device_id", "i", "j"))
def q_correlation_findings(spark, sf_dir):
    return stats.correlation_findings(stats.correlation_matrix(clean(spark, sf_dir)))


@register("trend_line", S.cte(**S.base("r1")) + f"""
select *, coalesce(abs(r) > 0.3, false) as draw from (
select device_id, regr_slope(temperature_sht, cast(light as double)) as slope,
       regr_intercept(temperature_sht, cast(light as double)) as intercept, {sc('light', 'temperature_sht')} as r,
       cast(regr_count(temperature_sht, cast(light as double)) as bigint) as n from clean group by all) t""",
          doubles=("slope", "intercept", "r"), ints=("device_id",))
def q_trend_line(spark, sf_dir):
    return stats.trend_line(clean(spark, sf_dir), "light", "temperature_sht")


def _weekly_sql(src="clean", sensor="temperature_sht", p=""):
    return {
        f"{p}cells": f"""select device_id, isodow(gw_timestamp) - 1 as day_of_week, hour(gw_timestamp) as hour,
                     avg(cast({sensor} as double)) as value from {src} group by all""",
        f"{p}sp": f"""select device_id, c // 24 as day_of_week, c % 24 as hour
                  from (select device_id, unnest(range(0, 168)) as c from (select distinct device_id from {src}) d) x""",
        f"{p}g": f"""select sp.device_id, sp.day_of_week, sp.hour, cells.value from {p}sp sp left join {p}cells cells
                on cells.device_id = sp.device_id and cells.day_of_week = sp.day_of_week and cells.hour = sp.hour""",
        f"{p}wp": f"""select *, case when max(value) over w > min(value) over w
                 then (value - min(value) over w) / (max(value) over w - min(value) over w)
                 when value is not null then 0.0 end as scaled from {p}g window w as (partition by device_id)""",
    }


@register("weekly_pattern", S.cte(**S.base("r2"), **_weekly_sql()) + " select * from wp",
          doubles=("value", "scaled"), ints=("device_id", "day_of_week", "hour"))
def q_weekly_pattern(spark, sf_dir):
    return stats.weekly_pattern(clean(spark, sf_dir, "r2"), "temperature_sht")


@register("weekly_extremes", S.cte(**S.base("r2"), **_weekly_sql()) + """
select device_id,
  first(day_of_week order by value, day_of_week, hour) filter (where value is not null) as low_day,
  first(hour order by value, day_of_week, hour) filter (where value is not null) as low_hour, min(value) as low_value,
  first(day_of_week order by value desc, day_of_week, hour) filter (where value is not null) as high_day,
  first(hour order by value desc, day_of_week, hour) filter (where value is not null) as high_hour,
  max(value) as high_value, avg(value) filter (where day_of_week < 5) as weekday_avg,
  avg(value) filter (where day_of_week >= 5) as weekend_avg,
  avg(value) filter (where day_of_week < 5) - avg(value) filter (where day_of_week >= 5) as weekday_minus_weekend
from wp group by all""", doubles=("low_value", "high_value", "weekday_avg", "weekend_avg", "weekday_minus_weekend"),
          ints=("device_id", "low_day", "low_hour", "high_day", "high_hour"))
def q_weekly_extremes(spark, sf_dir):
    return stats.weekly_extremes(stats.weekly_pattern(clean(spark, sf_dir, "r2"), "temperature_sht"))


_SPLIT = "2024-01-16 00:00:00"


@register("weekly_pattern_diff", S.cte(
    **S.base("r1"), **_weekly_sql(f"(select * from clean where gw_timestamp < timestamp '{_SPLIT}')", p="a_"),
    **_weekly_sql(f"(select * from clean where gw_timestamp >= timestamp '{_SPLIT}')", p="b_")) + """
select coalesce(a.device_id, b.device_id) as device_id, coalesce(a.day_of_week, b.day_of_week) as day_of_week,
       coalesce(a.hour, b.hour) as hour, a.value as value_a, b.value as value_b, a.value - b.value as diff
from a_wp a full join b_wp b on a.device_id = b.device_id and a.day_of_week = b.day_of_week and a.hour = b.hour""",
          doubles=("value_a", "value_b", "diff"), ints=("device_id", "day_of_week", "hour"))
def q_weekly_pattern_diff(spark, sf_dir):
    c = clean(spark, sf_dir)
    a = stats.weekly_pattern(time_range(c, {"start": None, "end": _SPLIT}), "temperature_sht")
    b = stats.weekly_pattern(time_range(c, {"start": _SPLIT, "end": None}), "temperature_sht")
    return stats.weekly_pattern_diff(a, b)


@register("weekly_blocks", S.cte(**S.base("r1"), g="""select device_id,
    case when isodow(gw_timestamp) - 1 >= 5 then 'weekend' else 'weekday' end as day_group,
    cast(floor(hour(gw_timestamp) / 2) * 2 as int) as block_start, avg(temperature_sht) as value
    from clean group by all""") + """
select *, value = min(value) over (partition by device_id) as is_lowest,
       value = max(value) over (partition by device_id) as is_highest from g""",
          doubles=("value",), ints=("device_id", "block_start"))
def q_weekly_blocks(spark, sf_dir):
    return stats.weekly_blocks(clean(spark, sf_dir), "temperature_sht")


@register("calendar_month", S.cte(**S.base("r2"), d="""select device_id, strftime(gw_timestamp, '%Y-%m') as month,
    day(gw_timestamp) as day, temperature_sht as v from clean where temperature_sht is not null""",
                                  days="""select device_id, month, day, avg(v) as avg, min(v) as min, max(v) as max,
    stddev_samp(v) as std, count(*) as count from d group by all""") + """
select *, min(min) over (partition by device_id, month) as month_min,
       max(max) over (partition by device_id, month) as month_max from days""",
          doubles=("avg", "min", "max", "std", "month_min", "month_max"), ints=("device_id", "day"))
def q_calendar_month(spark, sf_dir):
    return stats.calendar_month(clean(spark, sf_dir, "r2"), "temperature_sht")


@register("day_extremes", S.cte(**S.base("r1")) + """
select device_id, cast(gw_timestamp as date) as date,
  first(gw_timestamp order by temperature_sht, gw_timestamp) filter (where temperature_sht is not null) as min_time,
  min(temperature_sht) as min_value,
  first(gw_timestamp order by temperature_sht desc, gw_timestamp) filter (where temperature_sht is not null) as max_time,
  max(temperature_sht) as max_value, max(temperature_sht) - min(temperature_sht) as "range"
from clean group by all having count(temperature_sht) > 0""",
          doubles=("min_value", "max_value", '"range"'), ts=("min_time", "max_time"), dates=("date",),
          ints=("device_id",))
def q_day_extremes(spark, sf_dir):
    return stats.day_extremes(clean(spark, sf_dir), "temperature_sht")


@register("day_hourly", S.cte(**S.base("r1"), d="""select device_id, cast(gw_timestamp as date) as date,
    hour(gw_timestamp) as hour, cast(light as double) as v from clean""",
                              m="select device_id, date, hour, avg(v) as value from d group by all",
                              sp="""select device_id, date, unnest(range(0, 24)) as hour
                                    from (select distinct device_id, date from d) x""") + """
select sp.device_id, sp.date, sp.hour, m.value from sp
left join m on m.device_id = sp.device_id and m.date = sp.date and m.hour = sp.hour""",
          doubles=("value",), dates=("date",), ints=("device_id", "hour"))
def q_day_hourly(spark, sf_dir):
    return stats.day_hourly(clean(spark, sf_dir), "light")


@register("daily_aggregates_by_hour", S.cte(**S.base("r1")) + """
select device_id, cast(gw_timestamp as date) as date, hour(gw_timestamp) as hour, avg(temperature_sht) as avg,
       min(temperature_sht) as min, max(temperature_sht) as max, stddev_samp(temperature_sht) as std,
       count(temperature_sht) as count from clean group by all""",
          doubles=("avg", "min", "max", "std"), dates=("date",), ints=("device_id", "hour"))
def q_daily_aggregates_by_hour(spark, sf_dir):
    return stats.daily_aggregates_by_hour(clean(spark, sf_dir), "temperature_sht")


@register("data_quality_metrics", S.cte(**S.base("r2"), d="""select device_id, cast(gw_timestamp as date) as date,
    count(*) as rows, quantile_cont(temperature_sht, 0.5) as daily_median from clean group by all""") + """
select *, greatest(0.0, 1 - rows / 2880.0) * 100 as missing_pct,
       daily_median - quantile_cont(daily_median, 0.5) over (partition by device_id
          order by date_diff('day', date '1970-01-01', date) range between 7 preceding and 1 preceding) as drift
from (select s.device_id, s.date, coalesce(d.rows, 0) as rows, d.daily_median
      from (select device_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from d group by device_id) s
      left join d on d.device_id = s.device_id and d.date = s.date) x""",
          doubles=("daily_median", "missing_pct", "drift"), dates=("date",), ints=("device_id", "rows"))
def q_data_quality_metrics(spark, sf_dir):
    return stats.data_quality_metrics(clean(spark, sf_dir, "r2"))


@register("custom_agg", S.cte(**S.base("r1")) + """
select device_id, hour(gw_timestamp) as hour, max(sound_level) - min(sound_level) as sound_range,
       count(distinct color_hex) as colors from clean group by all""", ints=("device_id", "hour"))
def q_custom_agg(spark, sf_dir):
    c = clean(spark, sf_dir).withColumn("hour", F.hour("gw_timestamp"))
    return stats.custom_agg(c, ["hour"], (F.max("sound_level") - F.min("sound_level")).alias("sound_range"),
                            F.count_distinct("color_hex").alias("colors"))


@register("scatter_sample", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, light as x, temperature_sht as y from (
    select *, row_number() over (partition by device_id
               order by md5(concat_ws(':', 42, device_id, epoch_us(gw_timestamp))), gw_timestamp, light, temperature_sht) as rn
    from clean where light is not null and temperature_sht is not null)
where rn <= 1000""", doubles=("x", "y"), ts=("gw_timestamp",), ints=("device_id",))
def q_scatter_sample(spark, sf_dir):
    return stats.scatter_sample(clean(spark, sf_dir), "light", "temperature_sht", n=1000)


@register("scatter_sample_size", S.cte(**S.base("r1")) + """
select device_id, least(count(*), 1000) as points from clean
where light is not null and temperature_sht is not null group by all""", ints=("device_id",))
def q_scatter_sample_size(spark, sf_dir):
    s = stats.scatter_sample(clean(spark, sf_dir), "light", "temperature_sht", n=1000)
    return s.groupBy("device_id").agg(F.count(F.lit(1)).alias("points"))


_HL = "\nunion all ".join(f"select device_id, hour_ts, '{c}' as sensor, {c} as value from h where {c} is not null"
                          for c in ["temp", "humidity", "pressure", "light", "sound"])


@register("lag_matrix", S.cte(**S.base("r1"), h=S.hourly("clean"), hl=_HL) + f"""
select a.device_id, a.x, b.y, a.lag_hours, {sc('a.xv', 'b.yv')} as correlation
from (select device_id, hour_ts, sensor as x, value as xv, unnest(range(-12, 13)) as lag_hours from hl) a
join (select device_id, hour_ts, sensor as y, value as yv from hl) b
  on b.device_id = a.device_id and b.hour_ts = a.hour_ts + to_hours(a.lag_hours)
group by all""", doubles=("correlation",), ints=("device_id", "lag_hours"))
def q_lag_matrix(spark, sf_dir):
    return stats.lag_matrix(stats.hourly_long(grain.hourly_resample(clean(spark, sf_dir))))


@register("seasonal_decompose", S.cte(**S.base("r2"), h=S.hourly("clean"), d="""
select device_id, hour_ts, temp as value,
       case when count(temp) over w = 25 then avg(temp) over w end as trend,
       (isodow(hour_ts) - 1) * 24 + hour(hour_ts) as how
from h window w as (partition by device_id order by hour_ts rows between 12 preceding and 12 following)""",
                                      s="select device_id, how, avg(value - trend) as seasonal from d group by all") + """
select d.device_id, d.hour_ts, d.value, d.trend, s.seasonal, d.value - d.trend - s.seasonal as residual
from d left join s on s.device_id = d.device_id and s.how = d.how""",
          doubles=("value", "trend", "seasonal", "residual"), ts=("hour_ts",), ints=("device_id",))
def q_seasonal_decompose(spark, sf_dir):
    return stats.seasonal_decompose(grain.hourly_resample(clean(spark, sf_dir, "r2")), "temp")


# ---------------------------------------------------------------------------
# rollups
# ---------------------------------------------------------------------------

_ROLL_COLS = ("device_id", "sensor", "bucket", "avg", "min", "max", "std", "count", "sum")
_ROLL_D = ("avg", "min", "max", "std", "sum")


def _roll_sql(trunc: str) -> str:
    return f"""select device_id, sensor, date_trunc('{trunc}', gw_timestamp) as bucket, avg(value) as avg,
       min(value) as min, max(value) as max, stddev_samp(value) as std, count(value) as count, sum(value) as sum
from lf group by all"""


for _g, _t in (("hourly", "hour"), ("daily", "day"), ("monthly", "month")):
    def _mk(g=_g):
        def q(spark, sf_dir):
            return grain.rollup(clean(spark, sf_dir, "r2" if g == "monthly" else "r1"), g).select(*_ROLL_COLS)
        return q

    register(f"rollup_{_g}", S.cte(**S.base("r2" if _g == "monthly" else "r1"),
                                   lf=unpivot_sql("clean", nulls=False)) + _roll_sql(_t),
             doubles=_ROLL_D, ts=("bucket",), ints=("device_id",))(_mk())


@register("rollup_daily_from_hourly", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + _roll_sql("day"),
          doubles=_ROLL_D, ts=("bucket",), ints=("device_id",))
def q_rollup_daily_from_hourly(spark, sf_dir):
    """Daily rollup merged from the hourly one (moments), checked against raw daily aggregates."""
    return grain.rollup_from_rollup(grain.rollup(clean(spark, sf_dir), "hourly"), "daily").select(*_ROLL_COLS)


_RANGE = {"start": "2024-01-01 00:00:00", "end": "2024-01-31 00:00:00"}


@register("stats_from_rollup", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + f"""
select device_id, sensor, avg(value) as mean, min(value) as min, max(value) as max, count(value) as count,
       stddev_samp(value) as std from lf
where gw_timestamp >= timestamp '{_RANGE['start']}' and gw_timestamp < timestamp '{_RANGE['end']}' group by all""",
          doubles=("mean", "min", "max", "std"), ints=("device_id",))
def q_stats_from_rollup(spark, sf_dir):
    """Range statistics through the router: a 30-day range reads the daily rollup (not raw rows)."""
    span_h = (dt.datetime.fromisoformat(_RANGE["end"]) - dt.datetime.fromisoformat(_RANGE["start"])).total_seconds() / 3600
    g = grain.rollup_router(span_h)
    roll = grain.rollup(clean(spark, sf_dir), g if g != "raw" else "hourly")
    roll = time_range(roll, _RANGE, ts_col="bucket")
    return grain.stats_from_rollup(roll).select("device_id", "sensor", "mean", "min", "max", "count", "std")


_PART = ("2024-01-05 07:20:00", "2024-01-17 15:40:00")


@register("stats_over_range", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + f"""
select device_id, sensor, avg(value) as mean, min(value) as min, max(value) as max, count(value) as count,
       stddev_samp(value) as std from lf
where gw_timestamp >= timestamp '{_PART[0]}' and gw_timestamp < timestamp '{_PART[1]}' group by all""",
          doubles=("mean", "min", "max", "std"), ints=("device_id",))
def q_stats_over_range(spark, sf_dir):
    """A range that begins and ends within an hour: days, hours and raw edges together equal the raw rows."""
    c = clean(spark, sf_dir)
    lo, hi = map(dt.datetime.fromisoformat, _PART)
    r = grain.range_rollup(c, grain.rollup(c, "hourly"), grain.rollup(c, "daily"), lo, hi)
    return grain.stats_from_rollup(r).select("device_id", "sensor", "mean", "min", "max", "count", "std")


def _folder(spark, name: str) -> str:
    """A fresh folder for stored tables, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("live_rollup", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + _roll_sql("hour"),
          doubles=_ROLL_D, ts=("bucket",), ints=("device_id",))
def q_live_rollup(spark, sf_dir):
    """Readings that arrive in three batches, one hour of device 1 late, the last batch run twice: the stored
    hourly table equals the rollup of all readings."""
    c = clean(spark, sf_dir)
    ts, root = F.col("gw_timestamp"), _folder(spark, "live-rollup")
    late = (F.col("device_id") == 1) & (hour_floor(ts) == F.lit("2024-01-03 05:00:00").cast("timestamp_ntz"))
    day = F.dayofmonth(ts)
    for i, arrived in enumerate((~late & (day <= 10), ~late & (day > 10) & (day <= 20), late | (day > 20))):
        c.where(arrived).write.mode("append").parquet(f"{root}/in")
        live_rollup(spark, f"{root}/in", f"{root}/out", f"{root}/ck").awaitTermination()
    rollups.merge_batch(c.where(arrived), f"{root}/out", i)
    return spark.read.parquet(f"{root}/out/hourly").select(*_ROLL_COLS)


_STALE = {"upto": "2024-04-01 12:34:00", "start": "2024-01-03 05:10:00", "end": "2024-04-20 17:45:00"}


@register("rollup_store_stale", S.cte(**S.base("r2"), lf=unpivot_sql("clean", nulls=False)) + f"""
select device_id, sensor, avg(value) as mean, min(value) as min, max(value) as max, count(value) as count,
       stddev_samp(value) as std from lf
where gw_timestamp >= timestamp '{_STALE['start']}' and gw_timestamp < timestamp '{_STALE['end']}' group by all""",
          doubles=("mean", "min", "max", "std"), ints=("device_id",))
def q_rollup_store_stale(spark, sf_dir):
    """A long unaligned range through the router over a store that ends weeks before the raw readings."""
    c = clean(spark, sf_dir, "r2")
    root = rollups.build_rollups(c.where(F.col("gw_timestamp") < F.lit(_STALE["upto"]).cast("timestamp_ntz")), _folder(spark, "rollups"))
    lo, hi = (dt.datetime.fromisoformat(_STALE[k]) for k in ("start", "end"))
    return rollups.range_statistics(c, root, lo, hi)


_REFRESH = {"upto": "2024-01-20 10:30:00", "as_of": "2024-01-21 09:00:00"}


@register("rollup_store_refresh", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + f"""
select device_id, sensor, date_trunc('day', gw_timestamp) as bucket, avg(value) as avg,
       min(value) as min, max(value) as max, stddev_samp(value) as std, count(value) as count, sum(value) as sum
from lf where gw_timestamp <= timestamp '{_REFRESH['as_of']}' group by all""",
          doubles=_ROLL_D, ts=("bucket",), ints=("device_id",))
def q_rollup_store_refresh(spark, sf_dir):
    """A stored rollup whose last day is recomputed by the hourly job: its daily table equals one from all readings so far."""
    c = clean(spark, sf_dir)
    root = rollups.build_rollups(c.where(F.col("gw_timestamp") < F.lit(_REFRESH["upto"]).cast("timestamp_ntz")), _folder(spark, "rollups"))
    rollups.refresh_rollups(c, root, dt.datetime.fromisoformat(_REFRESH["as_of"]), hours=24)
    return spark.read.parquet(f"{root}/daily").select(*_ROLL_COLS)


@register("merge_rollup", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + """
select device_id, sensor, date_trunc('day', gw_timestamp) as bucket, avg(value) as avg,
       count(value) as count from lf group by all""",
          doubles=("avg",), ts=("bucket",), ints=("device_id",))
def q_merge_rollup(spark, sf_dir):
    """A stored rollup with stale rows of one device's later days, refreshed by key: equal to one from all rows."""
    c = clean(spark, sf_dir)
    late = (F.col("device_id") == 1) & (F.col("bucket") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    full = grain.rollup(c, "daily")
    stale = full.withColumn("avg", F.when(late, F.lit(-1.0)).otherwise(F.col("avg")))
    return grain.merge_rollup(stale, full.where(late)).select("device_id", "sensor", "bucket", "avg", "count")


@register("mean_of_daily_means", S.cte(**S.base("r1"), lf=unpivot_sql("clean", nulls=False)) + """
select device_id, sensor, avg(a) as mean_of_bucket_means, count(*) as buckets from (
  select device_id, sensor, date_trunc('day', gw_timestamp) as d, avg(value) as a from lf group by all) x group by all""",
          doubles=("mean_of_bucket_means",), ints=("device_id",))
def q_mean_of_daily_means(spark, sf_dir):
    return grain.stats_from_rollup(grain.rollup(clean(spark, sf_dir), "daily")).select(
        "device_id", "sensor", "mean_of_bucket_means", "buckets")


def _ds_cols():
    return ", ".join(f"avg({s}) as {s}_avg, min({s}) as {s}_min, max({s}) as {s}_max" for s in NUMERIC_SENSORS)


@register("downsample", S.cte(**S.base("r1")) + f"""
select device_id, time_bucket(interval '15 minutes', gw_timestamp) as bucket, count(*) as rows, {_ds_cols()}
from clean group by all""", doubles=tuple(f"{s}_avg" for s in NUMERIC_SENSORS)
          + tuple(f"{s}_{m}" for s in ("temperature_sht", "humidity", "pressure") for m in ("min", "max")),
          ts=("bucket",), ints=("device_id",))
def q_downsample(spark, sf_dir):
    return grain.downsample(clean(spark, sf_dir), "15 minutes")
