"""Queries: fixed-offset sections, light/activity sections, gaps, episodes, weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtrace.functions.timefn import localize
from roomtrace.operators import grain, profiles, series, weather
from roomtrace.operators.clean import clean_audit, infer_utc_offset, offset_frame, skip_malformed
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, raw, register
from roomtrace.sources.fixtures import weather_w1


def sc(x: str, y: str) -> str:
    """Pairwise-complete Pearson r in DuckDB, NULL for zero variance."""
    both = f"{x} is not null and {y} is not null"
    xm, ym = f"case when {both} then {x} end", f"case when {both} then {y} end"
    return f"(covar_samp({xm}, {ym}) / nullif(stddev_samp({xm}) * stddev_samp({ym}), 0))"


def lh(col: str) -> str:
    """local hour + minute/60 of a UTC column."""
    lt = S.local(col)
    return f"(hour({lt}) + minute({lt}) / 60.0)"


def us(a: str, b: str) -> str:
    """seconds a - b."""
    return f"(date_diff('microsecond', {b}, {a}) / 1e6)"


def RA(fixture="r1"):
    return {"raw": S.R1 if fixture == "r1" else S.R2, "ra": S.offset_frame("raw")}


def ra(spark, sf_dir, fixture="r1"):
    return offset_frame(raw(spark, sf_dir, fixture))


# ---------------------------------------------------------------------------
# fixed-offset sections
# ---------------------------------------------------------------------------

@register("workday_pulse", S.cte(**RA()) + """
select device_id, hour, quantile_cont(sound_level, 0.5) as sound_median, stddev_samp(sound_level) as sound_std,
       quantile_cont(light, 0.5) as light_median from ra group by all""",
          doubles=("sound_median", "sound_std", "light_median"), ints=("device_id", "hour"))
def q_workday_pulse(spark, sf_dir):
    return profiles.workday_pulse(ra(spark, sf_dir))


_SEASONAL = """
select device_id, month, quantile_cont(peak_hour, 0.5) as peak_hour from (
  select device_id, strftime(pk, '%Y-%m') as month, hour(pk) + minute(pk) / 60.0 as peak_hour from (
    select device_id, date, max(light) as mx,
           first(local_time order by light desc, local_time) filter (where light is not null) as pk
    from ra group by all) d where mx > 10) p group by all"""


@register("seasonal_light", S.cte(**RA("r2")) + _SEASONAL, doubles=("peak_hour",), ints=("device_id",))
def q_seasonal_light(spark, sf_dir):
    return profiles.seasonal_light(ra(spark, sf_dir, "r2"))


@register("thermal_profile", S.cte(**RA()) + """
select device_id, hour, avg(temperature_sht) as temperature_sht from ra group by all""",
          doubles=("temperature_sht",), ints=("device_id", "hour"))
def q_thermal_profile(spark, sf_dir):
    return profiles.thermal_profile(ra(spark, sf_dir))


@register("sound_floor", S.cte(**RA("r2")) + """
select device_id, month, quantile_cont(sound_level, 0.1) as sound_floor from ra group by all""",
          doubles=("sound_floor",), ints=("device_id",))
def q_sound_floor(spark, sf_dir):
    return profiles.sound_floor(ra(spark, sf_dir, "r2"))


_TOPCOLOR = """
select m.device_id, m.month, coalesce(t.color_hex, '#000000') as color_hex
from (select distinct device_id, month from ra) m
left join (select device_id, month, first(color_hex order by n desc, color_hex) as color_hex
           from (select device_id, month, color_hex, count(*) as n from ra
                 where color_hex is not null and color_hex <> '#000000' group by all) c group by all) t
  on t.device_id = m.device_id and t.month = m.month"""


@register("monthly_top_color", S.cte(**RA("r2")) + _TOPCOLOR, ints=("device_id",))
def q_monthly_top_color(spark, sf_dir):
    return profiles.monthly_top_color(ra(spark, sf_dir, "r2"))


@register("dataset_meta", S.cte(**RA()) + """
select device_id, count(*) as row_count, min(local_time) as start_date, max(local_time) as end_date,
       first(inferred_offset) as inferred_offset from ra group by all""",
          ts=("start_date", "end_date"), ints=("device_id", "inferred_offset"))
def q_dataset_meta(spark, sf_dir):
    return profiles.dataset_meta(ra(spark, sf_dir))


@register("infer_utc_offset", S.cte(raw=S.R2) + f"select * from ({S.offsets('raw')}) o",
          ints=("device_id", "inferred_offset"))
def q_infer_utc_offset(spark, sf_dir):
    return infer_utc_offset(skip_malformed(raw(spark, sf_dir, "r2")))


@register("clean_drop", S.cte(**RA()) + """
select device_id, count(*) as kept_rows, count(distinct date) as days, min(pressure) as min_pressure,
       max(light) as max_light from ra group by all""",
          doubles=("min_pressure",), ints=("device_id",))
def q_clean_drop(spark, sf_dir):
    return ra(spark, sf_dir).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("kept_rows"), F.count_distinct("date").alias("days"),
        F.min("pressure").alias("min_pressure"), F.max("light").alias("max_light"))


@register("clean_mask", S.cte(**S.base("r1")) + """
select device_id, count(*) as rows, count(pressure) as pressure_rows, count(light) as light_rows,
       max(light) as max_light, min(pressure) as min_pressure, sum(light) as light_sum from clean group by all""",
          doubles=("min_pressure",), ints=("device_id", "light_sum"))
def q_clean_mask(spark, sf_dir):
    return clean(spark, sf_dir).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("pressure").alias("pressure_rows"),
        F.count("light").alias("light_rows"), F.max("light").alias("max_light"),
        F.min("pressure").alias("min_pressure"), F.sum("light").alias("light_sum"))


@register("clean_audit", S.cte(raw=S.R1) + """
select device_id, count(*) as source_rows, count(*) filter (where gw_timestamp is null) as invalid_gw_timestamp,
       count(*) filter (where pressure < 900) as pressure_lt_900_hpa,
       count(*) filter (where light > 70000) as light_gt_70000_clear_counts,
       count(*) filter (where timestamp_monotonic is null) as corrupt_monotonic_non_numeric
from raw group by all""", ints=("device_id",))
def q_clean_audit(spark, sf_dir):
    return clean_audit(raw(spark, sf_dir))


# ---------------------------------------------------------------------------
# light and activity
# ---------------------------------------------------------------------------

def _light_days_sql(min_samples=50):
    return {
        "lit": "select * from loc where light is not null",
        "day": f"""select device_id, local_date, count(light) as n, quantile_cont(light, 0.95) as p95,
       quantile_cont(light, 0.9) as p90, first(gw_timestamp order by light desc, gw_timestamp) as pk_t,
       max(light) as pk_v from lit group by all
       having count(light) >= {min_samples} and quantile_cont(light, 0.95) >= 100""",
        "bright": """select l.device_id, l.local_date, min(l.gw_timestamp) as b0, max(l.gw_timestamp) as b1
       from lit l join day d on l.device_id = d.device_id and l.local_date = d.local_date
       where l.light >= d.p90 group by all""",
        "ld": f"""select d.device_id, d.local_date as date, strftime(d.local_date, '%Y-%m') as month,
       {lh('pk_t')} as peak_hour, cast(pk_v as double) as peak_light, {lh('b0')} as bright_start,
       {lh('b1')} as bright_end, {us('b1', 'b0')} / 3600.0 as bright_span_h
       from day d join bright b on b.device_id = d.device_id and b.local_date = d.local_date""",
    }


@register("light_days", S.cte(**S.base("r1"), **_light_days_sql()) + " select * from ld",
          doubles=("peak_hour", "peak_light", "bright_start", "bright_end", "bright_span_h"), dates=("date",),
          ints=("device_id",))
def q_light_days(spark, sf_dir):
    return profiles.light_days(loc(spark, sf_dir))


_MONTHLY_LIGHT = """
select device_id, month, quantile_cont(peak_hour, 0.5) as peak_hour, quantile_cont(bright_span_h, 0.5) as bright_span_h,
       quantile_cont(peak_light, 0.5) as peak_light, count(date) as days from ld group by all"""


@register("monthly_light", S.cte(**S.base("r2"), **_light_days_sql()) + _MONTHLY_LIGHT,
          doubles=("peak_hour", "bright_span_h", "peak_light"), ints=("device_id",))
def q_monthly_light(spark, sf_dir):
    return profiles.monthly_light(profiles.light_days(loc(spark, sf_dir, "r2")))


@register("light_shift", S.cte(**S.base("r2"), **_light_days_sql(), ml=_MONTHLY_LIGHT) + """
select device_id, max(peak_hour) - min(peak_hour) as peak_shift_hours, min(peak_hour) as earliest_peak_hour,
       max(peak_hour) as latest_peak_hour from ml group by all""",
          doubles=("peak_shift_hours", "earliest_peak_hour", "latest_peak_hour"), ints=("device_id",))
def q_light_shift(spark, sf_dir):
    return profiles.light_shift(profiles.monthly_light(profiles.light_days(loc(spark, sf_dir, "r2"))))


_DA = """select device_id, local_date, quantile_cont(light, 0.75) as light_p75,
       quantile_cont(sound_level, 0.75) as sound_p75, quantile_cont(light, 0.9) as light_p90,
       quantile_cont(sound_level, 0.9) as sound_p90, count(*) as rows from loc group by all"""


def _rank(v):
    return (f"case when {v} is not null then (rank() over (partition by device_id order by {v} nulls last) "
            f"+ (count(*) over (partition by device_id, {v}) - 1) / 2.0) / count({v}) over (partition by device_id) end")


_AC = {
    "da": _DA,
    "rk": f"select *, {_rank('light_p75')} as light_rank, {_rank('sound_p75')} as sound_rank from da",
    "scd": "select *, (light_rank + sound_rank) / 2.0 as activity_score from rk",
    "q": """select device_id, quantile_cont(activity_score, 0.25) as q1, quantile_cont(activity_score, 0.75) as q3
            from scd group by all""",
    "ac": """select scd.*, case when activity_score >= q3 then 'active' when activity_score <= q1 then 'quiet'
            else 'middle' end as activity_class from scd join q on q.device_id = scd.device_id""",
}
_AC_DOUBLES = ("light_p75", "sound_p75", "light_p90", "sound_p90", "light_rank", "sound_rank", "activity_score")


@register("daily_activity", S.cte(**S.base("r1"), da=_DA) + " select * from da",
          doubles=_AC_DOUBLES[:4], dates=("local_date",), ints=("device_id",))
def q_daily_activity(spark, sf_dir):
    return profiles.daily_activity(loc(spark, sf_dir))


@register("activity_class", S.cte(**S.base("r1"), **_AC) + " select * from ac",
          doubles=_AC_DOUBLES, dates=("local_date",), ints=("device_id",))
def q_activity_class(spark, sf_dir):
    return profiles.activity_class(profiles.daily_activity(loc(spark, sf_dir)))


@register("activity_class_counts", S.cte(**S.base("r1"), **_AC) + """
select device_id, activity_class, count(*) as days from ac group by all""", ints=("device_id",))
def q_activity_class_counts(spark, sf_dir):
    return profiles.activity_class_counts(profiles.activity_class(profiles.daily_activity(loc(spark, sf_dir))))


def _prof_cols():
    out = []
    for lab in ("quiet", "active"):
        f = f"filter (where activity_class = '{lab}')"
        out += [f"quantile_cont(light, 0.5) {f} as {lab}_light", f"quantile_cont(sound_level, 0.5) {f} as {lab}_sound",
                f"quantile_cont(temperature_sht, 0.5) {f} as {lab}_temp"]
    return ", ".join(out)


@register("activity_profile", S.cte(**S.base("r1"), **_AC) + f"""
, j as (select l.*, c.activity_class from loc l left join ac c on c.device_id = l.device_id and c.local_date = l.local_date),
prof as (select device_id, hour, {_prof_cols()} from j group by all),
sp as (select device_id, unnest(range(0, 24)) as hour from (select distinct device_id from loc) d)
select sp.device_id, sp.hour, prof.* exclude (device_id, hour) from sp
left join prof on prof.device_id = sp.device_id and prof.hour = sp.hour""",
          doubles=tuple(f"{a}_{b}" for a in ("quiet", "active") for b in ("light", "sound", "temp")),
          ints=("device_id", "hour"))
def q_activity_profile(spark, sf_dir):
    lc = loc(spark, sf_dir)
    return profiles.activity_profile(lc, profiles.activity_class(profiles.daily_activity(lc)))


@register("typical_day", S.cte(**S.base("r1")) + """
select device_id, hour, quantile_cont(light, 0.5) as light_median, quantile_cont(temperature_sht, 0.5) as temp_median
from loc group by all""", doubles=("light_median", "temp_median"), ints=("device_id", "hour"))
def q_typical_day(spark, sf_dir):
    return profiles.typical_day(loc(spark, sf_dir))


@register("routine_by_month", S.cte(**S.base("r2"), h=S.hourly("clean")) + """
select device_id, local_month as month,
       avg(case when coalesce(light > 300, false) or coalesce(sound > 20, false) then 1 else 0 end) * 24
         as active_hours_per_day,
       quantile_cont(light, 0.5) as light_median, quantile_cont(sound, 0.75) as sound_p75,
       quantile_cont(temp, 0.5) as temp_median, count(*) filter (where rows > 0) as sampled_hours
from h group by all""", doubles=("active_hours_per_day", "light_median", "sound_p75", "temp_median"),
          ints=("device_id",))
def q_routine_by_month(spark, sf_dir):
    return profiles.routine_by_month(grain.hourly_resample(clean(spark, sf_dir, "r2")))


_DAILY = """select device_id, local_date, quantile_cont(pressure, 0.5) as pressure,
       quantile_cont(temperature_sht, 0.5) as temp, quantile_cont(humidity, 0.5) as humidity,
       quantile_cont(light, 0.5) as light, quantile_cont(sound_level, 0.5) as sound
from loc group by all having quantile_cont(pressure, 0.5) is not null"""


@register("pressure_corr", S.cte(**S.base("r1"), d=_DAILY) + " union all ".join(
    f"select device_id, '{s}' as sensor, {sc('pressure', s)} as r from d group by device_id "
    for s in ["pressure", "temp", "humidity", "light", "sound"]).join(["\nselect * from (", ") u"]),
          doubles=("r",), ints=("device_id",))
def q_pressure_corr(spark, sf_dir):
    return profiles.pressure_corr(grain.daily_resample(loc(spark, sf_dir)))


@register("pressure_monthly", S.cte(**S.base("r2"), d=_DAILY) + """
select device_id, strftime(local_date, '%Y-%m') as month, quantile_cont(pressure, 0.5) as pressure
from d group by all""", doubles=("pressure",), ints=("device_id",))
def q_pressure_monthly(spark, sf_dir):
    return profiles.pressure_monthly(grain.daily_resample(loc(spark, sf_dir, "r2")))


@register("template_kpis", S.cte(**RA(), tp="select device_id, hour, avg(temperature_sht) as t from ra group by all")
          + """
select m.device_id, m.median_hourly_temp, r.raw_rows, k.kept_rows, r.raw_rows - k.kept_rows as dropped_rows
from (select device_id, quantile_cont(t, 0.5) as median_hourly_temp from tp group by all) m
join (select device_id, count(*) as raw_rows from raw group by all) r on r.device_id = m.device_id
join (select device_id, count(*) as kept_rows from ra group by all) k on k.device_id = m.device_id""",
          doubles=("median_hourly_temp",), ints=("device_id",))
def q_template_kpis(spark, sf_dir):
    return profiles.template_kpis(raw(spark, sf_dir), ra(spark, sf_dir))


# ---------------------------------------------------------------------------
# gaps, reboots, cadence, kpis
# ---------------------------------------------------------------------------

_GAPS = """select *, date_diff('microsecond', lag(gw_timestamp) over w, gw_timestamp) / 1e6 as gw_gap_s,
       timestamp_monotonic - lag(timestamp_monotonic) over w as mono_gap_s
from loc window w as (partition by device_id order by gw_timestamp, timestamp_monotonic)"""


def gaps_loc(spark, sf_dir, fixture="r1"):
    return series.time_gaps(loc(spark, sf_dir, fixture))


@register("time_gaps", S.cte(**S.base("r1"), g=_GAPS) + """
select device_id, gw_timestamp, gw_gap_s, mono_gap_s from g""",
          doubles=("gw_gap_s", "mono_gap_s"), ts=("gw_timestamp",), ints=("device_id",))
def q_time_gaps(spark, sf_dir):
    return gaps_loc(spark, sf_dir).select("device_id", "gw_timestamp", "gw_gap_s", "mono_gap_s")


@register("top_gaps", S.cte(**S.base("r1"), g=_GAPS) + """
select device_id, gw_timestamp, gw_gap_s, gw_gap_s / 3600.0 as gap_hours from g where gw_gap_s > 3600
qualify row_number() over (partition by device_id order by gw_gap_s desc, gw_timestamp) <= 8""",
          doubles=("gw_gap_s", "gap_hours"), ts=("gw_timestamp",), ints=("device_id",))
def q_top_gaps(spark, sf_dir):
    return series.top_gaps(gaps_loc(spark, sf_dir))


@register("gap_rows", S.cte(**S.base("r1"), g=_GAPS) + """
select device_id, gw_timestamp, gw_gap_s, gw_gap_s / 3600.0 as gap_hours from g where gw_gap_s > 3600""",
          doubles=("gw_gap_s", "gap_hours"), ts=("gw_timestamp",), ints=("device_id",))
def q_gap_rows(spark, sf_dir):
    return series.gap_rows(gaps_loc(spark, sf_dir))


@register("device_reboots", S.cte(**S.base("r1"), g=_GAPS) + """
select device_id, gw_timestamp, mono_gap_s from g where mono_gap_s < 0
qualify row_number() over (partition by device_id order by gw_timestamp) <= 12""",
          doubles=("mono_gap_s",), ts=("gw_timestamp",), ints=("device_id",))
def q_device_reboots(spark, sf_dir):
    return series.device_reboots(gaps_loc(spark, sf_dir))


@register("cadence_summary", S.cte(**S.base("r1"), g=_GAPS) + """
select device_id, min(gw_timestamp) as first_ts, max(gw_timestamp) as last_ts,
       quantile_cont(gw_gap_s, 0.5) as median_gap_s, max(gw_gap_s) / 3600.0 as max_gap_h from g group by all""",
          doubles=("median_gap_s", "max_gap_h"), ts=("first_ts", "last_ts"), ints=("device_id",))
def q_cadence_summary(spark, sf_dir):
    return series.cadence_summary(gaps_loc(spark, sf_dir))


@register("kpis", S.cte(**S.base("r1"), g=_GAPS) + f"""
select device_id, count(distinct local_date) as active_dates,
       cast(floor({us('max(gw_timestamp)', 'min(gw_timestamp)')} / 86400) + 1 as bigint) as total_span_days,
       quantile_cont(gw_gap_s, 0.5) as median_cadence_s, quantile_cont(temperature_sht, 0.5) as median_temp,
       count(*) filter (where gw_gap_s > 3600) as outages_gt_1h from g group by all""",
          doubles=("median_cadence_s", "median_temp"), ints=("device_id",))
def q_kpis(spark, sf_dir):
    return series.kpis(gaps_loc(spark, sf_dir))


# ---------------------------------------------------------------------------
# lag profile, robust z, anomaly episodes
# ---------------------------------------------------------------------------

def _lag_sql(src, x, y, lags):
    ks = ", ".join(str(k) for k in lags)
    return f"""select a.device_id, a.lag_hours, {sc('a.x', 'b.y')} as correlation
from (select device_id, hour_ts, {x} as x, unnest([{ks}]) as lag_hours from {src}) a
left join (select device_id, hour_ts, {y} as y from {src}) b
  on b.device_id = a.device_id and b.hour_ts = a.hour_ts + to_hours(a.lag_hours)
group by all"""


@register("lag_profile", S.cte(**S.base("r1"), h=S.hourly("clean")) + _lag_sql("h", "light", "temp", range(-12, 13)),
          doubles=("correlation",), ints=("device_id", "lag_hours"))
def q_lag_profile(spark, sf_dir):
    return series.lag_profile(grain.hourly_resample(clean(spark, sf_dir)))


@register("best_lag", S.cte(**S.base("r1"), h=S.hourly("clean"),
                            lp=_lag_sql("h", "light", "temp", range(-12, 13))) + """
select device_id, first(lag_hours order by correlation desc, lag_hours) as lag_hours,
       max(correlation) as correlation from lp where lag_hours >= 0 and correlation is not null group by all""",
          doubles=("correlation",), ints=("device_id", "lag_hours"))
def q_best_lag(spark, sf_dir):
    return series.best_lag(series.lag_profile(grain.hourly_resample(clean(spark, sf_dir))))


_COLS = ["temp", "humidity", "pressure", "light", "sound"]


def _score_sql():
    med = ", ".join(f"quantile_cont({c}, 0.5) as {c}_med" for c in _COLS)
    mad = ", ".join(f"quantile_cont(abs(h.{c} - m.{c}_med), 0.5) as {c}_mad" for c in _COLS)
    rz = ", ".join(f"case when {c}_mad is null or {c}_mad = 0 then 0.0 else 0.6745 * ({c} - {c}_med) / {c}_mad end "
                   f"as {c}_rz" for c in _COLS)
    score = " + ".join(f"coalesce(abs({c}_rz), 0.0)" for c in _COLS)
    return {
        "med": f"select device_id, {med} from h group by all",
        "mad": f"select h.device_id, {mad} from h join med m on m.device_id = h.device_id group by all",
        "rz": f"select h.*, {rz} from h join med using (device_id) join mad using (device_id)",
        "sco": f"select *, {score} as anomaly_score from rz",
        "thr": "select device_id, quantile_cont(anomaly_score, 0.995) as threshold from sco group by all",
        "ev": "select sco.*, thr.threshold, anomaly_score >= threshold as is_event from sco join thr using (device_id)",
    }


def _episodes_sql():
    return {
        "e1": """select *, case when lag(hour_ts) over w is null
                   or date_diff('microsecond', lag(hour_ts) over w, hour_ts) > 3600000000 then 1 else 0 end as nw
                 from ev where is_event window w as (partition by device_id order by hour_ts)""",
        "isl": "select *, sum(nw) over (partition by device_id order by hour_ts rows unbounded preceding) as episode from e1",
        "eps": f"""select device_id, episode, min(hour_ts) as start, max(hour_ts) as "end", max(anomaly_score) as score,
                 max(light) as peak_light, max(sound) as peak_sound, min(humidity) as min_humidity,
                 max(temp) - min(temp) as temp_span, count(*) as event_hours,
                 {us('max(hour_ts)', 'min(hour_ts)')} / 3600.0 + 1.0 as duration_h from isl group by all""",
    }


_EP_DOUBLES = ("score", "peak_light", "peak_sound", "min_humidity", "temp_span", "duration_h")


@register("anomaly_score", S.cte(**S.base("r1"), h=S.hourly("clean"), **_score_sql()) + """
select device_id, hour_ts, temp_rz, humidity_rz, pressure_rz, light_rz, sound_rz, anomaly_score, threshold, is_event
from ev""", doubles=("temp_rz", "humidity_rz", "pressure_rz", "light_rz", "sound_rz", "anomaly_score", "threshold"),
          ts=("hour_ts",), ints=("device_id",))
def q_anomaly_score(spark, sf_dir):
    return series.anomaly_score(grain.hourly_resample(clean(spark, sf_dir))).select(
        "device_id", "hour_ts", "temp_rz", "humidity_rz", "pressure_rz", "light_rz", "sound_rz", "anomaly_score",
        "threshold", "is_event")


@register("episodes", S.cte(**S.base("r2"), h=S.hourly("clean"), **_score_sql(), **_episodes_sql())
          + " select * from eps", doubles=_EP_DOUBLES, ts=("start", '"end"'), ints=("device_id", "episode"))
def q_episodes(spark, sf_dir):
    return series.episodes(series.anomaly_score(grain.hourly_resample(clean(spark, sf_dir, "r2"))))


def _labels_sql():
    rules = ", ".join(f"case when {c} {op} {t} then '{txt}' end" for c, op, t, txt in series.EPISODE_RULES)
    return {
        "w1": S.W1,
        "ew": """select e.device_id, e.episode, sum(w.precipitation) as rain_sum, max(w.wind_gusts_10m) as gust_max,
                 count(*) as weather_hours from eps e join w1 w on w.hour_ts between e.start and e."end" group by all""",
        "lab": f"""select eps.*, ew.rain_sum, ew.gust_max, ew.weather_hours,
                 coalesce(nullif(concat_ws(', ', {rules}), ''), '{series.DEFAULT_LABEL}') as label
                 from eps left join ew using (device_id, episode)""",
    }


@register("top_episodes", S.cte(**S.base("r1"), h=S.hourly("clean"), **_score_sql(), **_episodes_sql(),
                                **_labels_sql()) + """
select * from lab qualify row_number() over (partition by device_id order by score desc, start) <= 10""",
          doubles=_EP_DOUBLES + ("rain_sum", "gust_max"), ts=("start", '"end"'), ints=("device_id", "episode"))
def q_top_episodes(spark, sf_dir):
    eps = series.episodes(series.anomaly_score(grain.hourly_resample(clean(spark, sf_dir))))
    return series.top_episodes(series.episode_labels(eps, weather_w1(spark)))


# ---------------------------------------------------------------------------
# weather
# ---------------------------------------------------------------------------

def _hw_sql(fixture="r1"):
    return {**S.base(fixture), "h": S.hourly("clean"), "w1": S.W1,
            "hw": """select h.*, w.outdoor_temp_f, w.pressure_msl, w.precipitation, w.rain, w.wind_gusts_10m
                     from h join (select *, temperature_2m * 9 / 5 + 32 as outdoor_temp_f from w1) w
                     on w.hour_ts = h.hour_ts"""}


def hw(spark, sf_dir, fixture="r1"):
    return weather.join_weather(grain.hourly_resample(clean(spark, sf_dir, fixture)), weather_w1(spark))


_WD = """select device_id, local_date as date, coalesce(sum(rain), 0.0) as rain_mm,
       count(*) filter (where precipitation > 0) as precip_hours, avg(outdoor_temp_f) as outdoor_temp_f,
       quantile_cont(temp, 0.5) as indoor_temp_f, quantile_cont(light, 0.5) as indoor_light,
       quantile_cont(sound, 0.5) as indoor_sound, quantile_cont(pressure, 0.5) as indoor_pressure,
       quantile_cont(pressure_msl, 0.5) as outdoor_pressure, coalesce(sum(rain), 0.0) > 0 as rainy
from hw group by all"""


@register("join_weather", S.cte(**_hw_sql()) + """
select device_id, hour_ts, temp, outdoor_temp_f, pressure, pressure_msl, precipitation from hw""",
          doubles=("temp", "outdoor_temp_f", "pressure", "pressure_msl", "precipitation"), ts=("hour_ts",),
          ints=("device_id",))
def q_join_weather(spark, sf_dir):
    return hw(spark, sf_dir).select("device_id", "hour_ts", "temp", "outdoor_temp_f", "pressure", "pressure_msl",
                                    "precipitation")


@register("monthly_coupling", S.cte(**_hw_sql("r2")) + """
select *, indoor_temp_f - outdoor_temp_f as temp_delta_f, indoor_pressure - outdoor_pressure as pressure_gap_hpa from (
select device_id, local_month as month, quantile_cont(temp, 0.5) as indoor_temp_f,
       quantile_cont(outdoor_temp_f, 0.5) as outdoor_temp_f, quantile_cont(pressure, 0.5) as indoor_pressure,
       quantile_cont(pressure_msl, 0.5) as outdoor_pressure, quantile_cont(light, 0.5) as indoor_light,
       sum(precipitation) as precipitation_mm from hw group by all) m""",
          doubles=("indoor_temp_f", "outdoor_temp_f", "indoor_pressure", "outdoor_pressure", "indoor_light",
                   "precipitation_mm", "temp_delta_f", "pressure_gap_hpa"), ints=("device_id",))
def q_monthly_coupling(spark, sf_dir):
    return weather.monthly_coupling(hw(spark, sf_dir, "r2"))


_WD_DOUBLES = ("rain_mm", "outdoor_temp_f", "indoor_temp_f", "indoor_light", "indoor_sound", "indoor_pressure",
               "outdoor_pressure")


@register("weather_daily", S.cte(**_hw_sql(), wd=_WD) + " select * from wd", doubles=_WD_DOUBLES,
          dates=("date",), ints=("device_id",))
def q_weather_daily(spark, sf_dir):
    return weather.weather_daily(hw(spark, sf_dir))


@register("rainy_vs_dry", S.cte(**_hw_sql(), wd=_WD) + """
select device_id, rainy, quantile_cont(indoor_light, 0.5) as indoor_light, quantile_cont(indoor_sound, 0.5) as indoor_sound,
       quantile_cont(indoor_temp_f, 0.5) as indoor_temp_f, quantile_cont(outdoor_temp_f, 0.5) as outdoor_temp_f
from wd group by all""", doubles=("indoor_light", "indoor_sound", "indoor_temp_f", "outdoor_temp_f"),
          ints=("device_id",))
def q_rainy_vs_dry(spark, sf_dir):
    return weather.rainy_vs_dry(weather.weather_daily(hw(spark, sf_dir)))


@register("weather_compare", S.cte(**_hw_sql(), wd=_WD) + f"""
select * from (select device_id, count(*) as merged_hours, {sc('temp', 'outdoor_temp_f')} as indoor_outdoor_temp_corr,
       {sc('pressure', 'pressure_msl')} as indoor_outdoor_pressure_corr,
       quantile_cont(pressure - pressure_msl, 0.5) as pressure_gap_median_hpa from hw group by all) h
join (select device_id,
       quantile_cont(indoor_light, 0.5) filter (where rainy) as rainy_day_indoor_light_median,
       quantile_cont(indoor_light, 0.5) filter (where not rainy) as dry_day_indoor_light_median,
       quantile_cont(indoor_sound, 0.5) filter (where rainy) as rainy_day_indoor_sound_median,
       quantile_cont(indoor_sound, 0.5) filter (where not rainy) as dry_day_indoor_sound_median,
       count(*) filter (where rainy) as rainy_days, count(*) filter (where not rainy) as dry_days
      from wd group by all) d using (device_id)""",
          doubles=("indoor_outdoor_temp_corr", "indoor_outdoor_pressure_corr", "pressure_gap_median_hpa",
                   "rainy_day_indoor_light_median", "dry_day_indoor_light_median", "rainy_day_indoor_sound_median",
                   "dry_day_indoor_sound_median"), ints=("device_id",))
def q_weather_compare(spark, sf_dir):
    h = hw(spark, sf_dir)
    return weather.weather_compare(h, weather.weather_daily(h))


@register("outdoor_lag_profile", S.cte(**_hw_sql()) + _lag_sql("hw", "outdoor_temp_f", "temp", range(-24, 25, 2)),
          doubles=("correlation",), ints=("device_id", "lag_hours"))
def q_outdoor_lag_profile(spark, sf_dir):
    return weather.outdoor_lag_profile(hw(spark, sf_dir))


@register("episode_weather", S.cte(**S.base("r1"), h=S.hourly("clean"), **_score_sql(), **_episodes_sql(),
                                   w1=S.W1) + """
select e.device_id, e.episode, sum(w.precipitation) as rain_sum, max(w.wind_gusts_10m) as gust_max,
       count(*) as weather_hours from eps e join w1 w on w.hour_ts between e.start and e."end" group by all""",
          doubles=("rain_sum", "gust_max"), ints=("device_id", "episode"))
def q_episode_weather(spark, sf_dir):
    eps = series.episodes(series.anomaly_score(grain.hourly_resample(clean(spark, sf_dir))))
    return series.join_episode_weather(eps, weather_w1(spark))
