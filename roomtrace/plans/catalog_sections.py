"""Queries: the payload's section sentences, feed messages, ingest of device messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomtrace.operators import insights as I
from roomtrace.plans import sqlfrag as S
from roomtrace.plans.catalog import raw, register
from roomtrace.plans.catalog_color import _DISC
from roomtrace.plans.catalog_profiles import _AC, _DAILY, _MONTHLY_LIGHT, _hw_sql, _lag_sql, _light_days_sql, _prof_cols, sc
from roomtrace.plans.dashboard import section_sentences
from roomtrace.schema import FEED_KEYS
from roomtrace.sources.fixtures import message_lines, weather_w1
from roomtrace.streaming.live import parse_messages


def _fmt(x, d):
    return f"(case when {x} is null or isnan({x}) then 'n/a' else format('{{:,.{d}f}}', {x}) end)"


def _hl(h):
    hr = f"((cast(floor({h}) as bigint) % 24 + 24) % 24)"
    mi = f"(cast(round_even(({h} - floor({h})) * 60, 0) as bigint) % 60)"
    h12 = f"(case when {hr} % 12 = 0 then 12 else {hr} % 12 end)"
    suf = f"(case when {hr} < 12 then 'AM' else 'PM' end)"
    return (f"(case when {h} is null or isnan({h}) then 'n/a' when {mi} = 0 then {h12} || ' ' || {suf} "
            f"else {h12} || ':' || lpad(cast({mi} as varchar), 2, '0') || ' ' || {suf} end)")


def _fill(template, **slots):
    import re

    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        out.append(f"coalesce({slots[m.group(1)]}, 'n/a')")
        pos = m.end()
    out.append("'" + template[pos:].replace("'", "''") + "'")
    return " || ".join(out)


_T = I.SECTION_TEXTS
_SEC = {
    "seasonal_light": _fill(_T["seasonal_light"], shift=_fmt("s.shift", 1), earliest=_hl("s.lo"), latest=_hl("s.hi")),
    "activity_profile": _fill(_T["activity_profile"], light=_fmt("p.al", 0), sound=_fmt("p.aso", 0)),
    "heat_lag": _fill(_T["heat_lag"], lag="cast(b.lag_hours as varchar)", r=_fmt("b.r", 2)),
    "color_modes": _fill(_T["color_modes"]),
    "discomfort": _fill(_T["discomfort"], hour=_hl("dh.hour")),
    "anomalies": _fill(_T["anomalies"]),
    "routine": _fill(_T["routine"]),
    "pressure": _fill(_T["pressure"], temp_r=_fmt("pr.pt", 2), sound_r=_fmt("pr.ps", 2)),
    "weather": _fill(_T["weather"], temp_r=_fmt("wc.t", 2), lag="cast(ob.lag_hours as varchar)", gap=_fmt("wc.g", 1)),
}

_PIECES = {
    **_hw_sql("r1"), **_light_days_sql(), "ml": _MONTHLY_LIGHT,
    "sh": "select device_id, max(peak_hour) - min(peak_hour) as shift, min(peak_hour) as lo, max(peak_hour) as hi "
          "from ml group by all",
    **_AC,
    "j": "select l.*, c.activity_class from loc l left join ac c on c.device_id = l.device_id "
         "and c.local_date = l.local_date",
    "prof": f"select device_id, hour, {_prof_cols()} from j group by all",
    "pa": "select device_id, max(coalesce(active_light, 0.0)) as al, max(coalesce(active_sound, 0.0)) as aso "
          "from prof group by all",
    "lp": _lag_sql("h", "light", "temp", range(-12, 13)),
    "bl": "select device_id, first(lag_hours order by correlation desc, lag_hours) as lag_hours, max(correlation) as r "
          "from lp where lag_hours >= 0 and correlation is not null group by all",
    "dd": f"select *, {_DISC} as discomfort from loc",
    "dbh": "select device_id, hour, quantile_cont(discomfort, 0.95) as p95 from dd group by all",
    "dhr": "select device_id, first(hour order by p95 desc, hour) filter (where p95 is not null) as hour "
           "from dbh group by all",
    "d2": _DAILY,
    "prr": f"select device_id, {sc('pressure', 'temp')} as pt, {sc('pressure', 'sound')} as ps from d2 group by all",
    "wcx": f"select device_id, {sc('temp', 'outdoor_temp_f')} as t, quantile_cont(pressure - pressure_msl, 0.5) as g "
           "from hw group by all",
    "olp": _lag_sql("hw", "outdoor_temp_f", "temp", range(-24, 25, 2)),
    "obl": "select device_id, first(lag_hours order by correlation desc, lag_hours) as lag_hours "
           "from olp where lag_hours >= 0 and correlation is not null group by all",
    "dev": "select distinct device_id from clean",
}

_SEC_SQL = S.cte(**_PIECES) + "\nselect * from (" + "\nunion all ".join(
    f"""select dev.device_id, {i} as position, '{k}' as section, {v} as text from dev
  left join sh s on s.device_id = dev.device_id left join pa p on p.device_id = dev.device_id
  left join bl b on b.device_id = dev.device_id left join dhr dh on dh.device_id = dev.device_id
  left join prr pr on pr.device_id = dev.device_id left join wcx wc on wc.device_id = dev.device_id
  left join obl ob on ob.device_id = dev.device_id""" for i, (k, v) in enumerate(_SEC.items())) + ") u"


@register("insight_sections", _SEC_SQL, ints=("device_id", "position"))
def q_insight_sections(spark, sf_dir):
    # cleaned and hourly are written once to the shared checkpoint folder (lineage cut)
    return section_sentences(raw(spark, sf_dir), weather_w1(spark), cut_lineage=True)


_FEED_SQL = "\nunion all ".join(
    f"select device_id, gw_timestamp, '{c}' as sensor, cast({c} as varchar) as value, '{k}' as feed_key from raw "
    f"where {c} is not null" for c, k in FEED_KEYS.items())


@register("feed_messages", S.cte(raw=S.R1, f=_FEED_SQL) + " select * from f", ts=("gw_timestamp",),
          ints=("device_id",))
def q_feed_messages(spark, sf_dir):
    from roomtrace.sources.sinks import feed_messages

    return feed_messages(raw(spark, sf_dir))


STAMP = "2024-02-01 00:00:00"


@register("ingest_messages", S.cte(raw=S.R1) + f"""
select device_id, timestamp '{STAMP}' as gw_timestamp, timestamp_monotonic, cast(null as timestamp) as timestamp_iso,
       round_even((temperature_sht - 32) * 5 / 9 * 9 / 5 + 32, 2) as temperature_sht, humidity, pressure, light,
       sound_level, color_hex from raw""",
          doubles=("timestamp_monotonic", "temperature_sht", "humidity", "pressure"),
          ts=("gw_timestamp", "timestamp_iso"), ints=("device_id",))
def q_ingest_messages(spark, sf_dir):
    """Device JSON lines (with junk lines) -> validated, converted readings, stamped at a fixed time."""
    return parse_messages(message_lines(spark, sf_dir).select("value"),
                          stamp=F.lit(STAMP).cast("timestamp_ntz"))
