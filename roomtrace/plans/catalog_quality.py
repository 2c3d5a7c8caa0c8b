"""Queries: profiles, quality flags, provenance, recent rows, time ranges, calendar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtrace.functions.timefn import calendar_cols, localize, time_range
from roomtrace.operators import color, profiles, quality
from roomtrace.operators.clean import project_sensors
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, raw, register
from roomtrace.plans.catalog_color import _CF
from roomtrace.plans.catalog_profiles import _AC
from roomtrace.schema import CSV_FIELDNAMES, READINGS_SCHEMA

_TYPES = {f.name: f.dataType for f in READINGS_SCHEMA.fields}
_NUM = {"timestamp_monotonic", "temperature_sht", "humidity", "pressure", "light", "sound_level"}
_TIME = {"gw_timestamp", "timestamp_iso"}


def _profile_sql(src: str) -> str:
    parts = []
    for i, c in enumerate(CSV_FIELDNAMES):
        mn = f"cast(min({c}) as double)" if c in _NUM else "cast(null as double)"
        mx = f"cast(max({c}) as double)" if c in _NUM else "cast(null as double)"
        tn = f"min({c})" if c in _TIME else "cast(null as timestamp)"
        tx = f"max({c})" if c in _TIME else "cast(null as timestamp)"
        parts.append(f"""select device_id, {i} as position, '{c}' as column, '{_TYPES[c].simpleString()}' as type,
  (count(*) - count({c})) / count(*) as null_rate, count(distinct {c}) as unique_count,
  first(cast({c} as varchar) order by gw_timestamp) filter (where {c} is not null) as example,
  {mn} as min_value, {mx} as max_value, {tn} as min_time, {tx} as max_time from {src} group by device_id""")
    return "\nunion all ".join(parts)


@register("schema_profile", S.cte(raw=S.R1, sp=_profile_sql("raw")) + " select * from sp",
          doubles=("null_rate", "min_value", "max_value"), ts=("min_time", "max_time"), ints=("device_id", "position"))
def q_schema_profile(spark, sf_dir):
    return quality.schema_profile(raw(spark, sf_dir))


def _summary_sql(src: str) -> str:
    txt = "\nunion all ".join(
        f"""select device_id, gw_timestamp as _t, {i} as position, '{c}' as "column", cast({c} as varchar) as v
            from {src}"""
        for i, c in enumerate(CSV_FIELDNAMES))
    return f"""with lg as ({txt}),
g as (select device_id, position, "column", count(*) as _rows, count(v) as _n, count(distinct v) as unique_nonnull,
             count(try_cast(v as double)) as _num, min(try_cast(v as double)) as _min, max(try_cast(v as double)) as _max
      from lg group by all),
ex as (select device_id, "column", string_agg(v, ', ' order by _t, v) as examples from (
         select * from lg where v is not null
         qualify row_number() over (partition by device_id, "column" order by _t, v) <= 3) e group by all),
tr as (select device_id, min(gw_timestamp) as _t0, max(gw_timestamp) as _t1 from {src} group by all),
k as (select g.*, case when "column" = 'gw_timestamp' then 'datetime'
                  when _num > 0 and _num >= greatest(3.0, _rows * 0.5) then 'numeric' else 'categorical' end as kind
      from g)
select k.device_id, k.position, k."column", round((_rows - _n) / _rows * 100, 3) as null_rate, unique_nonnull,
       ex.examples, kind as type, case when kind = 'numeric' then _min end as min,
       case when kind = 'numeric' then _max end as max, case when kind = 'datetime' then _t0 end as date_min,
       case when kind = 'datetime' then _t1 end as date_max
from k left join ex on ex.device_id = k.device_id and ex."column" = k."column" join tr on tr.device_id = k.device_id"""


@register("column_summary", S.cte(raw=S.R1) + " select * from (" + _summary_sql("raw") + ") s",
          doubles=("null_rate", "min", "max"), ts=("date_min", "date_max"), ints=("device_id", "position"))
def q_column_summary(spark, sf_dir):
    return quality.column_summary(raw(spark, sf_dir))


@register("quality_flags", S.cte(raw=S.R1) + f"""
select f.*, d.duplicate_rows from
(select device_id, count(*) filter (where temperature_sht < 0) as negative_temperature,
        count(*) filter (where light = 0) as zero_light, count(*) filter (where sound_level > 100) as high_sound
 from raw group by all) f
join (select device_id, cast(sum(c - 1) as bigint) as duplicate_rows from (
        select {', '.join(['device_id'] + CSV_FIELDNAMES)}, count(*) as c from raw group by all) x group by all) d
  on d.device_id = f.device_id""", ints=("device_id",))
def q_quality_flags(spark, sf_dir):
    return quality.quality_flags(raw(spark, sf_dir))


@register("provenance", S.cte(raw=S.R1, clean=S.clean_mask("raw")) + f"""
select a.*, b.rows_after_timestamp_cleaning, b.utc_start, b.utc_end, b.rows_with_any_null_sensor,
       {S.local('b.utc_start')} as local_start, {S.local('b.utc_end')} as local_end from
(select device_id, count(*) as source_rows, count(*) filter (where gw_timestamp is null) as invalid_gw_timestamp,
        count(*) filter (where pressure < 900) as pressure_lt_900_hpa,
        count(*) filter (where light > 70000) as light_gt_70000_clear_counts,
        count(*) filter (where timestamp_monotonic is null) as corrupt_monotonic_non_numeric from raw group by all) a
left join (select device_id, count(*) as rows_after_timestamp_cleaning, min(gw_timestamp) as utc_start,
                  max(gw_timestamp) as utc_end,
                  count(*) filter (where temperature_sht is null or humidity is null or pressure is null or light is null
                                   or sound_level is null or color_hex is null) as rows_with_any_null_sensor
           from clean group by all) b on b.device_id = a.device_id""",
          ts=("utc_start", "utc_end", "local_start", "local_end"), ints=("device_id",))
def q_provenance(spark, sf_dir):
    return quality.provenance(raw(spark, sf_dir), clean(spark, sf_dir))


_ROWCOLS = ["device_id", "gw_timestamp", "temperature_sht", "humidity", "pressure", "light", "sound_level", "color_hex"]
_RC = ", ".join(_ROWCOLS)


@register("first_rows", S.cte(**S.base("r1")) + f"""
select {_RC} from clean qualify row_number() over (partition by device_id order by gw_timestamp) <= 5""",
          doubles=("temperature_sht", "humidity", "pressure"), ts=("gw_timestamp",), ints=("device_id",))
def q_first_rows(spark, sf_dir):
    return quality.first_rows(clean(spark, sf_dir)).select(*_ROWCOLS)


@register("recent_readings", S.cte(**S.base("r1")) + f"""
select * from (select {_RC}, row_number() over (partition by device_id order by gw_timestamp desc) as recent_rank
from clean) x where recent_rank <= 50""",
          doubles=("temperature_sht", "humidity", "pressure"), ts=("gw_timestamp",), ints=("device_id", "recent_rank"))
def q_recent_readings(spark, sf_dir):
    return quality.recent_readings(clean(spark, sf_dir).select(*_ROWCOLS))


@register("latest_reading", S.cte(**S.base("r1")) + f"""
select {_RC} from clean qualify row_number() over (partition by device_id order by gw_timestamp desc) = 1""",
          doubles=("temperature_sht", "humidity", "pressure"), ts=("gw_timestamp",), ints=("device_id",))
def q_latest_reading(spark, sf_dir):
    return quality.latest_reading(clean(spark, sf_dir).select(*_ROWCOLS)).select(*_ROWCOLS)


def _range_sql(hours):
    return f"""select c.* from clean c join (select device_id, max(gw_timestamp) as m from clean group by all) x
  on x.device_id = c.device_id where c.gw_timestamp >= x.m - to_hours({hours})"""


@register("chart_series", S.cte(**S.base("r1"), tr=_range_sql(24 * 7)) + """
select device_id, gw_timestamp, cast(temperature_sht as double) as temperature, humidity, pressure,
       try_cast(cast(light as varchar) as bigint) as light, try_cast(cast(sound_level as varchar) as bigint) as sound
from tr""", doubles=("temperature", "humidity", "pressure"), ts=("gw_timestamp",), ints=("device_id",))
def q_chart_series(spark, sf_dir):
    return quality.chart_series(time_range(clean(spark, sf_dir), "7d"))


@register("time_range", S.cte(**S.base("r1"), tr=_range_sql(24)) + """
select device_id, count(*) as rows, min(gw_timestamp) as first_ts, max(gw_timestamp) as last_ts from tr group by all""",
          ts=("first_ts", "last_ts"), ints=("device_id",))
def q_time_range(spark, sf_dir):
    return time_range(clean(spark, sf_dir), "24h").groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("gw_timestamp").alias("first_ts"), F.max("gw_timestamp").alias("last_ts"))


@register("time_range_custom", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, light from clean
where gw_timestamp >= timestamp '2024-01-10 00:00:00' and gw_timestamp < timestamp '2024-01-12 00:00:00'""",
          ts=("gw_timestamp",), ints=("device_id",))
def q_time_range_custom(spark, sf_dir):
    return time_range(clean(spark, sf_dir), {"start": "2024-01-10T00:00:00Z", "end": "2024-01-12 00:00:00"}).select(
        "device_id", "gw_timestamp", "light")


@register("project_sensors", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, temperature_sht, humidity from clean""",
          doubles=("temperature_sht", "humidity"), ts=("gw_timestamp",), ints=("device_id",))
def q_project_sensors(spark, sf_dir):
    return project_sensors(clean(spark, sf_dir), ["temperature_sht", "humidity"])


@register("localize", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, local_ts, local_date, local_hour, local_month, hour from loc""",
          doubles=("local_hour",), ts=("gw_timestamp", "local_ts"), dates=("local_date",), ints=("device_id", "hour"))
def q_localize(spark, sf_dir):
    return localize(clean(spark, sf_dir)).select("device_id", "gw_timestamp", "local_ts", "local_date", "local_hour",
                                                 "local_month", "hour")


@register("calendar_cols", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, hour(local_ts) as cal_hour, cast(local_ts as date) as cal_date,
       strftime(local_ts, '%Y-%m') as cal_month, isodow(local_ts) - 1 as dow, isodow(local_ts) - 1 >= 5 as is_weekend,
       day(local_ts) as day_of_month from loc""",
          ts=("gw_timestamp",), dates=("cal_date",), ints=("device_id", "cal_hour", "dow", "day_of_month"))
def q_calendar_cols(spark, sf_dir):
    return calendar_cols(loc(spark, sf_dir)).select("device_id", "gw_timestamp", "cal_hour", "cal_date", "cal_month",
                                                    "dow", "is_weekend", "day_of_month")


@register("color_features", S.cte(**S.base("r1")) + f"""
select device_id, gw_timestamp, color_hex, r_ as r, g_ as g, b_ as b, brightness, warm_cool, color_mode from (
{_CF}) c""",
          doubles=("brightness",), ts=("gw_timestamp",), ints=("device_id", "r", "g", "b", "warm_cool"))
def q_color_features(spark, sf_dir):
    return color.color_frame(loc(spark, sf_dir)).select("device_id", "gw_timestamp", "color_hex", "r", "g", "b",
                                                        "brightness", "warm_cool", "color_mode")


@register("join_day_class", S.cte(**S.base("r1"), **_AC) + """
select l.device_id, c.activity_class, count(*) as rows, avg(l.light) as mean_light from loc l
left join ac c on c.device_id = l.device_id and c.local_date = l.local_date group by all""",
          doubles=("mean_light",), ints=("device_id",))
def q_join_day_class(spark, sf_dir):
    lc = loc(spark, sf_dir)
    classes = profiles.activity_class(profiles.daily_activity(lc)).select("device_id", "local_date", "activity_class")
    return (lc.join(classes, ["device_id", "local_date"], "left").groupBy("device_id", "activity_class")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("light").alias("mean_light")))
