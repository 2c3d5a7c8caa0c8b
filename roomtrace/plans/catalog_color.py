"""Queries: color operators, comfort and discomfort."""

from __future__ import annotations

from roomtrace.functions import exprs as X
from roomtrace.operators import color, comfort, grain
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import clean, loc, register
from roomtrace.sources.fixtures import raw_audio, raw_color

_HEXD = "'0123456789ABCDEF'"


def _hexpair(c: str, pos: int) -> str:
    hi = f"(strpos({_HEXD}, upper(substr({c}, {pos}, 1))) - 1)"
    lo = f"(strpos({_HEXD}, upper(substr({c}, {pos + 1}, 1))) - 1)"
    return f"(16 * {hi} + {lo})"


def _valid(c: str = "color_hex") -> str:
    return f"({c} is not null and regexp_matches({c}, '^#[0-9A-Fa-f]{{6}}$'))"


_CF = f"""select *, r_ + g_ + b_ as _sum, (r_ + g_ + b_) / 3.0 as brightness, r_ - b_ as warm_cool,
  case when (r_ + g_ + b_) / 3.0 < 20 then 'dark' when r_ - b_ > 20 then 'warm' when r_ - b_ < -20 then 'cool'
       else 'neutral' end as color_mode
from (select *, {_hexpair('color_hex', 2)} as r_, {_hexpair('color_hex', 4)} as g_, {_hexpair('color_hex', 6)} as b_
      from loc where {_valid()}) v"""


def _blend(keys: str, first: int | None = None) -> str:
    def ch(c):
        return f"cast(least(greatest(round_even(avg({c}), 0), 0.0), 255.0) as int)"

    return (f"select {keys}, printf('#%02X%02X%02X', {ch('r_')}, {ch('g_')}, {ch('b_')}) as dominant_color from "
            + (f"(select * from cf qualify row_number() over (partition by {keys} order by gw_timestamp) <= {first}) f "
               if first else "cf ") + "group by all")


def frame(spark, sf_dir, fixture="r1"):
    return color.color_frame(loc(spark, sf_dir, fixture))


_SHARES = ", ".join(f"count(*) filter (where color_mode = '{m}') / count(*) as {m}_share" for m in color.MODES)


@register("monthly_color_modes", S.cte(**S.base("r2"), cf=_CF, bl=_blend("device_id, local_month", 200)) + f"""
select s.device_id, s.local_month as month, {', '.join(m + '_share' for m in color.MODES)}, mean_brightness, dominant_color
from (select device_id, local_month, {_SHARES}, avg(brightness) as mean_brightness from cf group by all) s
join bl on bl.device_id = s.device_id and bl.local_month = s.local_month""",
          doubles=tuple(m + "_share" for m in color.MODES) + ("mean_brightness",), ints=("device_id",))
def q_monthly_color_modes(spark, sf_dir):
    return color.monthly_color_modes(frame(spark, sf_dir, "r2"))


@register("color_by_hour", S.cte(**S.base("r1"), cf=_CF, bl=_blend("device_id, local_date, hour")) + " select * from bl",
          dates=("local_date",), ints=("device_id", "hour"))
def q_color_by_hour(spark, sf_dir):
    return color.color_by_hour(frame(spark, sf_dir))


@register("color_timeline", S.cte(**S.base("r1"), d="select *, cast(gw_timestamp as date) as date from clean") + """
select s.device_id, s.date, s.sample_count, coalesce(m.dominant_color, '#000000') as dominant_color
from (select device_id, date, count(*) as sample_count from d group by all) s
left join (select device_id, date, first(color_hex order by n desc, color_hex) as dominant_color
           from (select device_id, date, color_hex, count(*) as n from d where color_hex is not null group by all) c
           group by all) m on m.device_id = s.device_id and m.date = s.date""",
          dates=("date",), ints=("device_id",))
def q_color_timeline(spark, sf_dir):
    return color.color_timeline(clean(spark, sf_dir))


def _ranked_sql(keys: str, src: str, n: int) -> str:
    on = " and ".join(f"t.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""select c.*, c.count / t.total * 100.0 as percentage,
       row_number() over (partition by {', '.join('c.' + k.strip() for k in keys.split(','))}
                          order by c.count desc, c.color_hex) as rank
from (select {keys}, color_hex, count(*) as count from {src} where color_hex is not null group by all) c
join (select {keys}, count(*) as total from {src} group by all) t on {on}
qualify rank <= {n}"""


@register("common_colors", S.cte(**S.base("r1")) + _ranked_sql("device_id", "clean", 6),
          doubles=("percentage",), ints=("device_id",))
def q_common_colors(spark, sf_dir):
    return color.common_colors(clean(spark, sf_dir))


@register("unique_colors", S.cte(**S.base("r1")) + """
select device_id, count(distinct color_hex) as unique_color_count from clean group by all""", ints=("device_id",))
def q_unique_colors(spark, sf_dir):
    return color.unique_colors(clean(spark, sf_dir))


@register("day_colors", S.cte(**S.base("r1"), d="select *, cast(gw_timestamp as date) as date from clean")
          + _ranked_sql("device_id, date", "d", 4), doubles=("percentage",), dates=("date",), ints=("device_id",))
def q_day_colors(spark, sf_dir):
    return color.day_colors(clean(spark, sf_dir))


@register("color_statistics", S.cte(**S.base("r1"), top=_ranked_sql("device_id", "clean", 10)) + """
select l.device_id, l.current, l.unique_count, t.most_common from
(select device_id, first(color_hex order by gw_timestamp desc) as current, count(distinct color_hex) as unique_count
 from clean group by all) l
left join (select device_id, string_agg(color_hex, ',' order by rank) as most_common from top group by all) t
 on t.device_id = l.device_id""", ints=("device_id",))
def q_color_statistics(spark, sf_dir):
    return color.color_statistics(clean(spark, sf_dir))


@register("color_diversity_trend", S.cte(**S.base("r2"), cf=_CF) + """
select device_id, month, distinct_colors,
       (distinct_colors - lag(distinct_colors) over w) / nullif(lag(distinct_colors) over w, 0) * 100.0 as pct_change
from (select device_id, local_month as month, count(distinct color_hex) as distinct_colors from cf group by all) m
window w as (partition by device_id order by month)""", doubles=("pct_change",), ints=("device_id",))
def q_color_diversity_trend(spark, sf_dir):
    return color.color_diversity_trend(frame(spark, sf_dir, "r2"))


@register("color_regime_change", S.cte(**S.base("r1"), cf=_CF) + """
select device_id, local_date, warm_cool, prev_warm_cool,
       case when warm_cool > 0 then 'warm' when warm_cool < 0 then 'cool' else 'neutral' end as regime
from (select *, lag(warm_cool) over (partition by device_id order by local_date) as prev_warm_cool
      from (select device_id, local_date, avg(warm_cool) as warm_cool from cf group by all) d) x
where sign(warm_cool) <> sign(prev_warm_cool)""", doubles=("warm_cool", "prev_warm_cool"), dates=("local_date",),
          ints=("device_id",))
def q_color_regime_change(spark, sf_dir):
    return color.color_regime_change(frame(spark, sf_dir))


@register("warmest_hours", S.cte(**S.base("r1"), cf=_CF) + """
select device_id, first(hour order by wc desc, hour) as warmest_hour, max(wc) as warmest_wc,
       first(hour order by wc, hour) as coolest_hour, min(wc) as coolest_wc
from (select device_id, hour, avg(warm_cool) as wc from cf group by all) h group by all""",
          doubles=("warmest_wc", "coolest_wc"), ints=("device_id", "warmest_hour", "coolest_hour"))
def q_warmest_hours(spark, sf_dir):
    return color.warmest_hours(frame(spark, sf_dir))


_NAME_CASE = "case upper(color_hex) " + " ".join(
    f"when '{k}' then '{v}'" for k, v in X.COLOR_NAMES.items()) + " else 'Custom Color' end"


@register("color_swatches", S.cte(**S.base("r1")) + f"""
select device_id, color_hex, n,
       (299 * {_hexpair('color_hex', 2)} + 587 * {_hexpair('color_hex', 4)} + 114 * {_hexpair('color_hex', 6)}) / 1000.0 as luma,
       case when (299 * {_hexpair('color_hex', 2)} + 587 * {_hexpair('color_hex', 4)} + 114 * {_hexpair('color_hex', 6)}) / 1000.0 > 125
            then 'black' else 'white' end as label_color,
       {_NAME_CASE} as color_name
from (select device_id, color_hex, count(*) as n from clean where {_valid()} group by all) c""",
          doubles=("luma",), ints=("device_id",))
def q_color_swatches(spark, sf_dir):
    return color.color_swatches(clean(spark, sf_dir))


def _sc(c):
    return f"coalesce(least(greatest(cast(trunc({c} / 786.0 * 255) as int), 0), 255), 0)"


@register("rgb_to_hex", S.cte(rc=S.RAW_COLOR) + f"""
select device_id, ts, c, printf('#%02X%02X%02X', {_sc('r')}, {_sc('g')}, {_sc('b')}) as color_hex from rc""",
          ts=("ts",), ints=("device_id", "c"))
def q_rgb_to_hex(spark, sf_dir):
    return color.hex_from_raw(raw_color(spark, sf_dir))


@register("sound_rms", S.cte(ra=S.RAW_AUDIO) + """
select device_id, ts, cast(round_even(sqrt(list_sum(list_transform(samples, lambda x: cast(x - 32768 as double) * (x - 32768)))
       / len(samples)), 0) as bigint) as sound_level from ra""", ts=("ts",), ints=("device_id",))
def q_sound_rms(spark, sf_dir):
    return raw_audio(spark, sf_dir).select("device_id", "ts", X.sound_rms("samples").alias("sound_level"))


# ---------------------------------------------------------------------------
# comfort
# ---------------------------------------------------------------------------

def _clip0(e):
    return f"(case when ({e}) is null then null else greatest(cast({e} as double), 0.0) end)"


_DISC = (f"{_clip0('temperature_sht - 88.0')} * 0.5 + {_clip0('22.0 - humidity')} * 1.0 "
         f"+ {_clip0('cast(sound_level as double) - 120.0')} * 0.03")


@register("discomfort_by_hour", S.cte(**S.base("r1"), d=f"select *, {_DISC} as discomfort from loc") + """
select device_id, hour, quantile_cont(discomfort, 0.95) as discomfort_p95, quantile_cont(temperature_sht, 0.95) as temperature_p95,
       quantile_cont(humidity, 0.05) as humidity_p05, quantile_cont(sound_level, 0.95) as sound_p95 from d group by all""",
          doubles=("discomfort_p95", "temperature_p95", "humidity_p05", "sound_p95"), ints=("device_id", "hour"))
def q_discomfort_by_hour(spark, sf_dir):
    return comfort.discomfort_by_hour(loc(spark, sf_dir))


@register("discomfort_days", S.cte(**S.base("r1"), d=f"select *, {_DISC} as discomfort from loc") + """
select * from (select device_id, local_date, quantile_cont(discomfort, 0.95) as discomfort_p95,
       max(temperature_sht) as temp_max, min(humidity) as humidity_min, quantile_cont(sound_level, 0.95) as sound_p95
       from d group by all) x
qualify row_number() over (partition by device_id order by discomfort_p95 desc nulls last, local_date) <= 8""",
          doubles=("discomfort_p95", "temp_max", "humidity_min", "sound_p95"), dates=("local_date",),
          ints=("device_id",))
def q_discomfort_days(spark, sf_dir):
    return comfort.discomfort_days(loc(spark, sf_dir))


def comfort_sql(t="temperature_sht", h="humidity", lt="cast(light as double)", s="cast(sound_level as double)",
                weights=None):
    ts = (f"(case when {t} between 68 and 74 then 100.0 when {t} between 65 and 77 then 80.0 "
          f"when {t} between 60 and 80 then 60.0 else greatest(0.0, 100 - abs({t} - 71) * 5) end)")
    hs = (f"(case when {h} between 40 and 50 then 100.0 when {h} between 35 and 55 then 80.0 "
          f"when {h} between 30 and 60 then 60.0 else greatest(0.0, 100 - abs({h} - 45) * 3) end)")
    ls = f"(case when {lt} between 500 and 2000 then 100.0 when {lt} between 200 and 3000 then 80.0 else 60.0 end)"
    ss = (f"(case when {s} < 100 then 100.0 when {s} < 200 then 80.0 when {s} < 400 then 60.0 "
          f"else greatest(0.0, 100 - ({s} - 400) / 5) end)")
    w = dict(X.COMFORT_WEIGHTS, **(weights or {}))
    raw =f"({ts} * {w['temperature']} + {hs} * {w['humidity']} + {ls} * {w['light']} + {ss} * {w['sound']})"
    anynull = f"({t} is null or {h} is null or {lt} is null or {s} is null)"
    rating = "case " + " ".join(f"when {raw} >= {c} then '{lab}'" for c, lab in X.COMFORT_RATINGS) + " else 'Very Poor' end"
    return {
        "temperature_score": f"case when {t} is not null then round_even({ts}, 1) end",
        "humidity_score": f"case when {h} is not null then round_even({hs}, 1) end",
        "light_score": f"case when {lt} is not null then round_even({ls}, 1) end",
        "sound_score": f"case when {s} is not null then round_even({ss}, 1) end",
        "comfort_index": f"case when not {anynull} then round_even({raw}, 1) end",
        "rating": f"case when not {anynull} then {rating} end",
    }


def heat_sql(t="temperature_sht", r="humidity"):
    c = X.HEAT_INDEX_COEF
    hi = (f"({c[0]} + {c[1]} * {t} + {c[2]} * {r} + {c[3]} * {t} * {r} + {c[4]} * {t} * {t} + {c[5]} * {r} * {r} "
          f"+ {c[6]} * {t} * {t} * {r} + {c[7]} * {t} * {r} * {r} + {c[8]} * {t} * {t} * {r} * {r})")
    return f"(case when {t} is null or {r} is null then null when {t} < 80 then {t} else round_even({hi}, 1) end)"


_CT = "select device_id, gw_timestamp, " + ", ".join(f"{v} as {k}" for k, v in comfort_sql().items()) + \
    f", {heat_sql()} as heat_index, local_date, hour from loc"
_CT_D = ("temperature_score", "humidity_score", "light_score", "sound_score", "comfort_index", "heat_index")


@register("comfort_timeline", S.cte(**S.base("r1"), ct=_CT) + """
select device_id, gw_timestamp, temperature_score, humidity_score, light_score, sound_score, comfort_index, rating,
       heat_index from ct""", doubles=_CT_D, ts=("gw_timestamp",), ints=("device_id",))
def q_comfort_timeline(spark, sf_dir):
    return comfort.comfort_timeline(loc(spark, sf_dir))


_HC = ("select device_id, date_trunc('hour', gw_timestamp) as hour_ts, avg(comfort_index) as comfort_index "
       "from ct group by all")


@register("uncomfortable_hours", S.cte(**S.base("r1"), ct=_CT, hc=_HC) + f"""
select device_id, cast({S.local('hour_ts')} as date) as local_date,
       count(*) filter (where comfort_index < 60) as uncomfortable_hours, count(comfort_index) as scored_hours
from hc group by all""", dates=("local_date",), ints=("device_id",))
def q_uncomfortable_hours(spark, sf_dir):
    return comfort.uncomfortable_hours(loc(spark, sf_dir))


@register("comfort_alerts", S.cte(**S.base("r1"), ct=_CT, hc=_HC) + """
select * from (select *, lag(comfort_index) over (partition by device_id order by hour_ts) as prev_comfort_index
from hc) x where comfort_index < 60 and prev_comfort_index >= 60""",
          doubles=("comfort_index", "prev_comfort_index"), ts=("hour_ts",), ints=("device_id",))
def q_comfort_alerts(spark, sf_dir):
    return comfort.comfort_alerts(loc(spark, sf_dir))


_ROOMS = """select device_id, avg(comfort_index) as mean_comfort,
       count(*) filter (where comfort_index >= 75) / count(comfort_index) as share_good,
       avg(temperature_score) as temperature_score, avg(humidity_score) as humidity_score,
       avg(light_score) as light_score, avg(sound_score) as sound_score from ct group by all"""


@register("compare_rooms", S.cte(**S.base("r1"), ct=_CT) + _ROOMS,
          doubles=("mean_comfort", "share_good", "temperature_score", "humidity_score", "light_score", "sound_score"),
          ints=("device_id",))
def q_compare_rooms(spark, sf_dir):
    return comfort.compare_rooms(loc(spark, sf_dir))


@register("comfort_suggestions", S.cte(**S.base("r1"), ct=_CT, rooms=_ROOMS) + " union all ".join(
    f"select device_id, '{k}' as score, {k} as value, '{v}' as suggestion from rooms where {k} < 80 "
    for k, v in comfort.SUGGESTIONS.items()).join(["\nselect * from (", ") u"]),
          doubles=("value",), ints=("device_id",))
def q_comfort_suggestions(spark, sf_dir):
    return comfort.comfort_suggestions(loc(spark, sf_dir))


@register("insight_health", S.cte(**S.base("r1"), ct=_CT) + """
select device_id, count(*) filter (where comfort_index >= 75) / count(comfort_index) * 100 as pct_in_comfort_zone
from ct group by all""", doubles=("pct_in_comfort_zone",), ints=("device_id",))
def q_insight_health(spark, sf_dir):
    return comfort.health_share(loc(spark, sf_dir))


def _window_sql(hours, name, band, smax):
    cs = comfort_sql()
    lf = f"(case when cast(light as double) between {band[0]} and {band[1]} then 100.0 else 60.0 end)"
    sf = f"(case when sound_level <= {smax} then 100.0 else 60.0 end)"
    score = f"(({cs['temperature_score']}) * 0.35 + ({cs['humidity_score']}) * 0.25 + {lf} * 0.2 + {sf} * 0.2)"
    hs = ", ".join(str(h) for h in hours)
    return f"select device_id, local_date, avg({score}) as {name} from loc where hour in ({hs}) group by all"


@register("sleep_index", S.cte(**S.base("r1")) + _window_sql([22, 23, 0, 1, 2, 3, 4, 5], "sleep_index", (0, 50), 100),
          doubles=("sleep_index",), dates=("local_date",), ints=("device_id",))
def q_sleep_index(spark, sf_dir):
    return comfort.sleep_index(loc(spark, sf_dir))


@register("productivity_index", S.cte(**S.base("r1")) + _window_sql(range(9, 17), "productivity_index", (500, 2000), 200),
          doubles=("productivity_index",), dates=("local_date",), ints=("device_id",))
def q_productivity_index(spark, sf_dir):
    return comfort.productivity_index(loc(spark, sf_dir))


@register("pressure_trend", S.cte(**S.base("r1"), h=S.hourly("clean")) + """
select *, case when pressure_change > 1.0 then 'rising' when pressure_change < -1.0 then 'falling'
               when pressure_change is not null then 'stable' end as trend
from (select device_id, hour_ts, pressure, pressure - lag(pressure, 3) over (partition by device_id order by hour_ts)
      as pressure_change from h) x""", doubles=("pressure", "pressure_change"), ts=("hour_ts",), ints=("device_id",))
def q_pressure_trend(spark, sf_dir):
    return comfort.pressure_trend(grain.hourly_resample(clean(spark, sf_dir)))


@register("normalize_device", S.cte(**S.base("r1")) + """
select device_id, gw_timestamp, round_even(temperature_sht, 2) as temperature_sht, round_even(humidity, 2) as humidity,
       round_even(pressure, 2) as pressure, round_even(timestamp_monotonic, 2) as timestamp_monotonic,
       case when year(timestamp_iso) > 2000 then timestamp_iso end as timestamp_iso from clean""",
          doubles=("temperature_sht", "humidity", "pressure", "timestamp_monotonic"), ts=("gw_timestamp", "timestamp_iso"),
          ints=("device_id",))
def q_normalize_device(spark, sf_dir):
    from roomtrace.operators.clean import normalize_device

    return normalize_device(clean(spark, sf_dir)).select(
        "device_id", "gw_timestamp", "temperature_sht", "humidity", "pressure", "timestamp_monotonic", "timestamp_iso")



@register("color_by_month", S.cte(**S.base("r2"), cf=_CF, bl=_blend("device_id, local_month")) + " select * from bl",
          ints=("device_id",))
def q_color_by_month(spark, sf_dir):
    return color.color_by_month(frame(spark, sf_dir, "r2"))


# A comfort profile: user-chosen weights (bands stay fixed); equal weights here.
PROFILE_WEIGHTS = {"temperature": 0.25, "humidity": 0.25, "light": 0.25, "sound": 0.25}


def _comfort_profile_sql():
    cs = comfort_sql(weights=PROFILE_WEIGHTS)
    return f"select device_id, gw_timestamp, {cs['comfort_index']} as comfort_index, {cs['rating']} as rating from loc"


@register("comfort_profile", S.cte(**S.base("r1")) + _comfort_profile_sql(), doubles=("comfort_index",),
          ts=("gw_timestamp",), ints=("device_id",))
def q_comfort_profile(spark, sf_dir):
    return comfort.comfort_timeline(loc(spark, sf_dir), weights=PROFILE_WEIGHTS).select(
        "device_id", "gw_timestamp", "comfort_index", "rating")
