"""Queries: z/IQR anomalies, context lookups, feedback, periods, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtrace.operators import anomalies as A
from roomtrace.operators import insights as I
from roomtrace.operators import periods as P
from roomtrace.operators import stats
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, register
from roomtrace.plans.catalog_profiles import us
from roomtrace.plans.catalog_stats import _FINDINGS, _STATS, _matrix_sql, unpivot_sql
from roomtrace.plans.present import present
from roomtrace.schema import NUMERIC_SENSORS
from roomtrace.sources.fixtures import events

_LF = unpivot_sql("clean", nulls=False)
_ST = """select device_id, sensor, avg(value) as mean, stddev_samp(value) as std, count(value) as n
         from lf group by all"""
_AZ = """select lf.device_id, lf.gw_timestamp, lf.sensor, lf.value, st.mean as expected_value,
       st.mean - 2 * st.std as expected_min, st.mean + 2 * st.std as expected_max,
       (lf.value - st.mean) / st.std as z_score,
       case when abs((lf.value - st.mean) / st.std) >= 3.0 then 'severe'
            when abs((lf.value - st.mean) / st.std) >= 2.5 then 'moderate' else 'minor' end as severity
from lf join st on st.device_id = lf.device_id and st.sensor = lf.sensor
where st.n >= 30 and st.std > 0 and abs((lf.value - st.mean) / st.std) >= 2.5"""
_AZ_D = ("value", "expected_value", "expected_min", "expected_max", "z_score")


def AZ(fixture="r1"):
    return {**S.base(fixture), "lf": _LF, "st": _ST, "az": _AZ}


def az(spark, sf_dir, fixture="r1"):
    return A.anomalies_z(clean(spark, sf_dir, fixture))


@register("anomalies_z", S.cte(**AZ()) + " select * from az", doubles=_AZ_D, ts=("gw_timestamp",),
          ints=("device_id",))
def q_anomalies_z(spark, sf_dir):
    return az(spark, sf_dir)


@register("anomaly_summary", S.cte(**AZ()) + """
select s.*, t.most_common_sensor, t.most_common_count from
(select device_id, count(*) as total_count, count(*) filter (where severity = 'severe') as severe,
        count(*) filter (where severity = 'moderate') as moderate, count(*) filter (where severity = 'minor') as minor
 from az group by all) s
join (select device_id, first(sensor order by n desc, sensor) as most_common_sensor, max(n) as most_common_count
      from (select device_id, sensor, count(*) as n from az group by all) c group by all) t
  on t.device_id = s.device_id""", ints=("device_id",))
def q_anomaly_summary(spark, sf_dir):
    return A.anomaly_summary(az(spark, sf_dir))


def _events(spark, sf_dir):
    return az(spark, sf_dir).select("device_id", "sensor", F.col("gw_timestamp").alias("event_ts"))


_CTX = """select e.device_id, e.sensor, e.event_ts, c.gw_timestamp, c.temperature_sht, c.humidity, c.pressure,
       c.light, c.sound_level
from (select device_id, sensor, gw_timestamp as event_ts from az) e
join clean c on c.device_id = e.device_id and c.gw_timestamp >= e.event_ts - interval 3 hour
            and c.gw_timestamp < e.event_ts + interval 3 hour"""
_CTX_COLS = ["device_id", "sensor", "event_ts", "gw_timestamp", "temperature_sht", "humidity", "pressure", "light",
             "sound_level"]


@register("context_window", S.cte(**AZ(), ctx=_CTX) + " select * from ctx",
          doubles=("temperature_sht", "humidity", "pressure"), ts=("event_ts", "gw_timestamp"), ints=("device_id",), presented=True)
def q_context_window(spark, sf_dir):
    # presented once per reading and event, not once per pair
    rows = clean(spark, sf_dir).select("device_id", "gw_timestamp", *NUMERIC_SENSORS)
    return A.context_window(rows, _events(spark, sf_dir), form=present).select(*_CTX_COLS)


_NEAR = """select * from ctx qualify row_number() over (partition by device_id, sensor, event_ts
           order by abs(date_diff('microsecond', event_ts, gw_timestamp)), gw_timestamp) = 1"""


@register("nearest_reading", S.cte(**AZ(), ctx=_CTX, near=_NEAR) + " select * from near",
          doubles=("temperature_sht", "humidity", "pressure"), ts=("event_ts", "gw_timestamp"), ints=("device_id",))
def q_nearest_reading(spark, sf_dir):
    return A.nearest_reading(clean(spark, sf_dir), _events(spark, sf_dir))


_NL = "\nunion all ".join(
    f"select device_id, sensor as event_sensor, event_ts, '{s}' as sensor, cast({s} as double) as value from near"
    for s in NUMERIC_SENSORS)


@register("anomaly_context_status", S.cte(**AZ(), ctx=_CTX, near=_NEAR, nl=_NL) + """
select nl.device_id, nl.event_sensor, nl.event_ts, nl.sensor, nl.value,
       case when st.std > 0 then abs((nl.value - st.mean) / st.std) else 0.0 end as z,
       case when (case when st.std > 0 then abs((nl.value - st.mean) / st.std) else 0.0 end) < 2.0
            then 'normal' else 'unusual' end as status
from nl left join st on st.device_id = nl.device_id and st.sensor = nl.sensor
where nl.sensor <> nl.event_sensor""", doubles=("value", "z"), ts=("event_ts",), ints=("device_id",))
def q_anomaly_context_status(spark, sf_dir):
    c = clean(spark, sf_dir)
    return A.anomaly_context_status(A.nearest_reading(c, _events(spark, sf_dir)), c)


@register("typical_at_hour", S.cte(**AZ()) + """
select az.*, hour(az.gw_timestamp) as hour, t.typical_mean, t.typical_std from az
left join (select device_id, sensor, hour(gw_timestamp) as hour, avg(value) as typical_mean,
                  stddev_samp(value) as typical_std from lf group by all) t
  on t.device_id = az.device_id and t.sensor = az.sensor and t.hour = hour(az.gw_timestamp)""",
          doubles=_AZ_D + ("typical_mean", "typical_std"), ts=("gw_timestamp",), ints=("device_id", "hour"))
def q_typical_at_hour(spark, sf_dir):
    return A.typical_at_hour(clean(spark, sf_dir), az(spark, sf_dir))


@register("previous_similar", S.cte(**AZ()) + """
select *, (select max(e.gw_timestamp) from az e where e.device_id = az.device_id and e.sensor = az.sensor
           and e.gw_timestamp < az.gw_timestamp and abs(e.z_score) >= abs(az.z_score)) as previous_similar
from az""", doubles=_AZ_D, ts=("gw_timestamp", "previous_similar"), ints=("device_id",))
def q_previous_similar(spark, sf_dir):
    return A.previous_similar(az(spark, sf_dir))


@register("anomalies_iqr", S.cte(**S.base("r1"), lf=_LF) + """
select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from (
  select lf.*, q.q1, q.q3 from lf join (select device_id, sensor, quantile_cont(value, 0.25) as q1,
       quantile_cont(value, 0.75) as q3 from lf group by all) q on q.device_id = lf.device_id and q.sensor = lf.sensor) x
where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
          doubles=("value", "q1", "q3", "lower_fence", "upper_fence"), ts=("gw_timestamp",), ints=("device_id",))
def q_anomalies_iqr(spark, sf_dir):
    return A.anomalies_iqr(clean(spark, sf_dir))


@register("zscore", S.cte(**S.base("r1")) + """
select c.device_id, c.gw_timestamp, c.temperature_sht, (c.temperature_sht - s.m) / nullif(s.s, 0) as temperature_sht_zscore
from clean c join (select device_id, avg(temperature_sht) as m, stddev_samp(temperature_sht) as s from clean group by all) s
  on s.device_id = c.device_id""", doubles=("temperature_sht", "temperature_sht_zscore"), ts=("gw_timestamp",),
          ints=("device_id",))
def q_zscore(spark, sf_dir):
    return A.zscore(clean(spark, sf_dir), "temperature_sht").select(
        "device_id", "gw_timestamp", "temperature_sht", "temperature_sht_zscore")


@register("moving_average", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, light, avg(cast(light as double)) over (partition by device_id order by gw_timestamp
       range between interval 1800 seconds preceding and current row) as light_ma from clean""",
          doubles=("light_ma",), ts=("gw_timestamp",), ints=("device_id",))
def q_moving_average(spark, sf_dir):
    return A.moving_average(clean(spark, sf_dir), "light", window_s=1800).select(
        "device_id", "gw_timestamp", "light", "light_ma")


@register("moving_average_rows", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, light, case when count(*) over w >= 10 then avg(cast(light as double)) over w end as light_ma
from clean window w as (partition by device_id order by gw_timestamp, timestamp_monotonic, light rows between 9 preceding and current row)""",
          doubles=("light_ma",), ts=("gw_timestamp",), ints=("device_id",))
def q_moving_average_rows(spark, sf_dir):
    """The export's smoothing over ten readings."""
    return A.moving_average_rows(clean(spark, sf_dir), "light", rows=10, min_rows=10).select(
        "device_id", "gw_timestamp", "light", "light_ma")


@register("suppress_false_positives", S.cte(**AZ(), fb="""select cast(user_id % 2 as int) as device_id,
    'sound_level' as sensor, ts as gw_timestamp from events where event_type = 'error'""") + """
select * from az anti join fb using (device_id, sensor, gw_timestamp)""",
          doubles=_AZ_D, ts=("gw_timestamp",), ints=("device_id",))
def q_suppress_false_positives(spark, sf_dir):
    fb = events(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "cast(user_id % 2 as int) as device_id", "'sound_level' as sensor", "ts as gw_timestamp")
    return A.suppress_false_positives(az(spark, sf_dir), fb)


# ---------------------------------------------------------------------------
# periods
# ---------------------------------------------------------------------------

P1 = {"start": "2024-02-01 00:00:00", "end": "2024-03-01 00:00:00"}
P2 = {"start": "2024-01-01 00:00:00", "end": "2024-02-01 00:00:00"}


def _inp(p):
    return f"(gw_timestamp >= timestamp '{p['start']}' and gw_timestamp < timestamp '{p['end']}')"


def _cmp_sql(p1, p2):
    aggs = []
    for i, p in ((1, p1), (2, p2)):
        f = f"filter (where {_inp(p)})"
        aggs += [f"avg(value) {f} as p{i}_mean", f"min(value) {f} as p{i}_min", f"max(value) {f} as p{i}_max",
                 f"stddev_samp(value) {f} as p{i}_std", f"count(value) {f} as p{i}_count"]
    return f"""select *, p1_mean - p2_mean as mean_diff, (p1_mean - p2_mean) / nullif(p2_mean, 0) * 100 as mean_diff_percent,
       p1_min - p2_min as min_diff, p1_max - p2_max as max_diff, p1_std - p2_std as std_diff from (
select device_id, sensor, {', '.join(aggs)} from lf where {_inp(p1)} or {_inp(p2)} group by all) g"""


_CMP_D = tuple(f"p{i}_{m}" for i in (1, 2) for m in ("mean", "min", "max", "std")) + (
    "mean_diff", "mean_diff_percent", "min_diff", "max_diff", "std_diff")


@register("compare_periods", S.cte(**S.base("r2"), lf=_LF, cmp=_cmp_sql(P1, P2)) + " select * from cmp",
          doubles=_CMP_D, ints=("device_id",))
def q_compare_periods(spark, sf_dir):
    return P.compare_periods(clean(spark, sf_dir, "r2"), P1, P2)


@register("compare_series", S.cte(**S.base("r2")) + " union all ".join(
    f"""select device_id, '{lab}' as period, gw_timestamp, cast(temperature_sht as double) as value,
        {us('gw_timestamp', f"timestamp '{p['start']}'")} as elapsed_s from clean
        where {_inp(p)} and temperature_sht is not null """ for lab, p in (("period1", P1), ("period2", P2))
).join(["\nselect * from (", ") u"]), doubles=("value", "elapsed_s"), ts=("gw_timestamp",), ints=("device_id",))
def q_compare_series(spark, sf_dir):
    return P.compare_series(clean(spark, sf_dir, "r2"), "temperature_sht", P1, P2)


@register("insight_period_change", S.cte(**S.base("r2"), lf=_LF, cmp=_cmp_sql(P1, P2)) + """
select *, abs(mean_diff_percent) as abs_pct from cmp where mean_diff_percent is not null
qualify row_number() over (partition by device_id order by abs(mean_diff_percent) desc, sensor) <= 3""",
          doubles=_CMP_D + ("abs_pct",), ints=("device_id",))
def q_insight_period_change(spark, sf_dir):
    return P.insight_period_change(P.compare_periods(clean(spark, sf_dir, "r2"), P1, P2))


AS_OF = "2024-01-29 00:00:00"
_W1P, _W2P = ({"start": "2024-01-22 00:00:00", "end": AS_OF}, {"start": "2024-01-15 00:00:00", "end": "2024-01-22 00:00:00"})


@register("compare_presets", S.cte(**S.base("r1"), lf=_LF, cmp=_cmp_sql(_W1P, _W2P)) + """
select *, coalesce(abs(mean_diff_percent) > 20.0, false) as flagged from cmp""",
          doubles=_CMP_D, ints=("device_id",))
def q_compare_presets(spark, sf_dir):
    return P.compare_presets(clean(spark, sf_dir), AS_OF, "week")


# ---------------------------------------------------------------------------
# insights
# ---------------------------------------------------------------------------

def _num(x, d=1):
    s = float(10 ** d)
    return f"cast(round(cast({x} as double) * {s}) / {s} as varchar)"


_NAME = "case sensor " + " ".join(f"when '{k}' then '{v}'" for k, v in I.SENSOR_NAMES.items()) + " else sensor end"


def _name(col):
    return _NAME.replace("case sensor", f"case {col}").replace("else sensor", f"else {col}")


_TREND = f"""select s.device_id, s.sensor,
       regr_slope(value, {us('lf.gw_timestamp', 't0')} / 86400.0) as daily_change, count(value) as n
from lf s join (select device_id, min(gw_timestamp) as t0 from clean group by all) f on f.device_id = s.device_id
group by all"""

_TREND_ROWS = f"""select device_id, 'trend' as category,
       case when abs(daily_change) > 2.0 then 'high' else 'medium' end as priority,
       {_name('sensor')} || ' is ' || case when daily_change > 0 then 'increasing' else 'decreasing' end as title,
       {_name('sensor')} || ' keeps ' || case when daily_change > 0 then 'increasing' else 'decreasing' end
         || ': ' || case when daily_change >= 0 then '+' else '' end || {_num('daily_change')} || ' a day by linear fit' as description,
       sensor, daily_change as metric
from tr where n >= 10 and abs(daily_change) > 0.5"""


def _trend_lf():
    return unpivot_sql("clean", sensors=["temperature_sht", "humidity", "pressure"], nulls=False)


@register("trend_slopes", S.cte(**S.base("r2"), lf=_trend_lf(), tr=_TREND.replace("lf.gw_timestamp", "s.gw_timestamp"))
          + " select * from tr", doubles=("daily_change",), ints=("device_id",))
def q_trend_slopes(spark, sf_dir):
    return I.trend_slopes(clean(spark, sf_dir, "r2"))


@register("trend_slopes_sample_index", S.cte(**S.base("r2"), ix="""
select device_id, temperature_sht, humidity, pressure, row_number() over (partition by device_id
       order by gw_timestamp, temperature_sht nulls first, humidity nulls first, pressure nulls first) - 1 as x from clean""")
          + """
select device_id, sensor, regr_slope(value, cast(x as double)) * 2880 as daily_change, count(value) as n
from (unpivot (select device_id, x, cast(temperature_sht as double) as temperature_sht, cast(humidity as double) as humidity,
                      cast(pressure as double) as pressure from ix) on temperature_sht, humidity, pressure into name sensor value value)
group by all""",
          doubles=("daily_change",), ints=("device_id",))
def q_trend_slopes_sample_index(spark, sf_dir):
    return I.trend_slopes(clean(spark, sf_dir, "r2"), mode="sample_index")


_INSIGHT_D = ("metric",)


@register("insight_trend", S.cte(**S.base("r2"), lf=_trend_lf(),
                                 tr=_TREND.replace("lf.gw_timestamp", "s.gw_timestamp")) + _TREND_ROWS,
          doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_trend(spark, sf_dir):
    return I.insight_trend(clean(spark, sf_dir, "r2"))


_WEEKEND = f"""select device_id, 'pattern' as category, 'medium' as priority,
       case when diff > 0 then 'Weekends' else 'Weekdays' end || ' stand out' as title,
       'Mean ' || {_name('sensor')} || ' is ' || {_num('abs(diff)')} || ' above the rest of the week on '
         || case when diff > 0 then 'weekends' else 'weekdays' end as description, sensor, diff as metric
from (select *, weekend_mean - weekday_mean as diff,
             abs((weekend_mean - weekday_mean) / nullif(weekday_mean, 0) * 100) as pct from (
      select device_id, sensor, avg(value) filter (where isodow(gw_timestamp) - 1 < 5) as weekday_mean,
             avg(value) filter (where isodow(gw_timestamp) - 1 >= 5) as weekend_mean from wl group by all) g) x
where pct > 10.0"""


@register("insight_weekend", S.cte(**S.base("r1"), wl=unpivot_sql(
    "clean", sensors=["temperature_sht", "light", "sound_level"], nulls=False)) + _WEEKEND,
          doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_weekend(spark, sf_dir):
    return I.insight_weekend(clean(spark, sf_dir))


_ORDER = "case sensor " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(I.SENSOR_NAMES)) + " end"
_ANOM = f"""select device_id, 'anomaly' as category, 'high' as priority, 'Outlying ' || {_name('sensor')} as title,
       severity || ' outlier at ' || strftime(gw_timestamp, '%Y-%m-%dT%H:%M:%S') || ': value '
         || {_num('value', 2)} || ', z-score magnitude ' || {_num('abs(z_score)')} as description,
       sensor, z_score as metric
from az qualify row_number() over (partition by device_id order by gw_timestamp desc, {_ORDER}) = 1"""


@register("insight_anomaly", S.cte(**AZ()) + _ANOM, doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_anomaly(spark, sf_dir):
    return I.insight_anomaly(az(spark, sf_dir))


REPORT_DATE = "2024-12-31 00:00:00"
_MILE = f"""select device_id, 'milestone' as category, 'low' as priority, 'Row count passed its mark' as title,
       n || ' readings are stored' as description, cast(null as varchar) as sensor,
       cast(n as double) as metric from mg where n > 500000
union all
select device_id, 'milestone', 'low', 'Monitoring time passed its mark',
       'First reading lies ' || cast(days as bigint) || ' days back', cast(null as varchar),
       cast(days as double) from mg where days >= 180"""
_MG = f"""select device_id, count(*) as n,
       floor({us(f"timestamp '{REPORT_DATE}'", 'min(gw_timestamp)')} / 86400) as days from clean group by all"""


@register("insight_milestone", S.cte(**S.base("r2"), mg=_MG) + _MILE, doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_milestone(spark, sf_dir):
    return I.insight_milestone(clean(spark, sf_dir, "r2"), as_of=REPORT_DATE)


_CORR = f"""select device_id, 'correlation' as category, 'medium' as priority,
       {_name('x')} || ' and ' || {_name('y')} || ' move together' as title,
       strength || ' ' || direction || ' correlation between ' || {_name('x')} || ' and ' || {_name('y')}
         || ' (r = ' || {_num('r', 2)} || ')' as description, x || '|' || y as sensor, r as metric
from fnd where abs_r >= 0.4"""


@register("insight_correlation", S.cte(**S.base("r1"), **_matrix_sql(), fnd=_FINDINGS) + _CORR,
          doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_correlation(spark, sf_dir):
    return I.insight_correlation(stats.correlation_findings(stats.correlation_matrix(clean(spark, sf_dir))))


_VS = f"""select device_id, 'comparison' as category, case when abs(pct) > 20 then 'medium' else 'low' end as priority,
       {_name('sensor')} || ' in ' || month || ' vs the month before' as title,
       {_name('sensor')} || ' was ' || {_num('abs(pct)', 0)} || '% '
         || case when pct >= 0 then 'higher' else 'lower' end || ' than last month' as description,
       sensor, pct as metric
from (select *, (mean - lag(mean) over (partition by device_id, sensor order by month))
               / nullif(lag(mean) over (partition by device_id, sensor order by month), 0) * 100 as pct
      from (select device_id, sensor, strftime({S.local('gw_timestamp')}, '%Y-%m') as month, avg(value) as mean
            from lf group by all) m) x where pct is not null"""


@register("insight_vs_last_period", S.cte(**S.base("r2"), lf=_LF) + _VS, doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_vs_last_period(spark, sf_dir):
    return I.insight_vs_last_period(clean(spark, sf_dir, "r2"))


_ARR = """select device_id, 'pattern' as category, 'low' as priority, 'Typical arrival time' as title,
       'Sound usually jumps around ' || lpad(cast(hour as varchar), 2, '0') || ':00 on weekdays (' || days || ' days)'
         as description, 'sound_level' as sensor, cast(hour as double) as metric
from (select device_id, first(hour order by days desc, hour) as hour, max(days) as days from (
  select device_id, hour, count(*) as days from (
    select device_id, local_date, first(hour order by rise desc, hour) as hour from (
      select *, s - lag(s) over (partition by device_id, local_date order by hour) as rise from (
        select device_id, local_date, hour, avg(sound_level) as s from loc where isodow(local_ts) - 1 < 5 group by all) h
    ) r where rise is not null group by all) d group by all) c group by all) b"""


@register("insight_arrival", S.cte(**S.base("r1")) + _ARR, doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_arrival(spark, sf_dir):
    return I.insight_arrival(loc(spark, sf_dir))


_QW = f"""select device_id, 'pattern' as category, 'low' as priority, 'Quieter week' as title,
       'The week of ' || cast(week as varchar) || ' was ' || {_num('abs(pct)', 0)} || '% quieter than usual' as description,
       'sound_level' as sensor, pct as metric
from (select w.*, (w.m - t.overall) / t.overall * 100 as pct from (
  select device_id, cast({S.local('gw_timestamp')} as date) - cast(isodow({S.local('gw_timestamp')}) - 1 as int) as week,
         avg(sound_level) as m from clean where sound_level is not null group by all) w
  join (select device_id, avg(sound_level) as overall from clean where sound_level is not null group by all) t
  on t.device_id = w.device_id) x where pct < -10.0"""


@register("insight_quiet_week", S.cte(**S.base("r2")) + _QW, doubles=_INSIGHT_D, ints=("device_id",))
def q_insight_quiet_week(spark, sf_dir):
    return I.insight_quiet_week(clean(spark, sf_dir, "r2"))


_DAYSUM = f"""select t.device_id, t.temp_range, c.most_stable, c.most_stable_cv, p.light_peak_ts,
       hour({S.local('p.light_peak_ts')}) + minute({S.local('p.light_peak_ts')}) / 60.0 as light_peak_local_hour
from (select device_id, max - min as temp_range from st where sensor = 'temperature_sht') t
left join (select device_id, first(sensor order by std_dev / mean * 100, sensor) as most_stable,
                  min(std_dev / mean * 100) as most_stable_cv from st
           where sensor in ('temperature_sht', 'humidity', 'pressure') and mean > 0 group by all) c
  on c.device_id = t.device_id
left join (select device_id, first(gw_timestamp order by light desc, gw_timestamp) filter (where light is not null)
                  as light_peak_ts from clean group by all) p on p.device_id = t.device_id"""


@register("insight_day_summary", S.cte(**S.base("r1"), lf=unpivot_sql("clean"),
                                       st=_STATS)
          + _DAYSUM, doubles=("temp_range", "most_stable_cv", "light_peak_local_hour"), ts=("light_peak_ts",),
          ints=("device_id",))
def q_insight_day_summary(spark, sf_dir):
    c = clean(spark, sf_dir)
    return I.insight_day_summary(c, stats.statistics(c))


@register("insights", S.cte(**S.base("r1"), lf=_LF, st=_ST, az=_AZ,
                            tl=_trend_lf().replace("from clean", "from clean"),
                            tr=_TREND.replace("from lf s", "from tl s").replace("lf.gw_timestamp", "s.gw_timestamp"),
                            wl=unpivot_sql("clean", sensors=["temperature_sht", "light", "sound_level"], nulls=False),
                            **_matrix_sql(), fnd=_FINDINGS, mg=_MG) + f"""
select *, case priority when 'high' then 0 when 'medium' then 1 when 'low' then 2 end as priority_rank from (
{_TREND_ROWS}
union all {_WEEKEND}
union all {_ANOM}
union all {_MILE}
union all {_CORR}) u""", doubles=_INSIGHT_D, ints=("device_id", "priority_rank"))
def q_insights(spark, sf_dir):
    return I.all_insights(clean(spark, sf_dir), as_of=REPORT_DATE)
