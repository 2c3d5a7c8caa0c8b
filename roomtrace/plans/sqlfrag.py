"""DuckDB SQL fragments that restate the operators for the oracle check.

These are the *definitions* of each result in plain SQL over the driver's
views; the Spark operators are written independently with the DataFrame
API.  ``cte(...)`` assembles a WITH clause from named fragments.
"""

from __future__ import annotations

from roomtrace.schema import DEFAULT_TZ
from roomtrace.sources.fixtures import r1_sql, r2_sql, r3_sql, raw_audio_sql, raw_color_sql, w1_sql

TZ = DEFAULT_TZ


def local(col: str, tz: str = TZ) -> str:
    return f"(({col} AT TIME ZONE 'UTC') AT TIME ZONE '{tz}')"


def cte(**parts: str) -> str:
    return "with " + ",\n".join(f"{k} as (\n{v}\n)" for k, v in parts.items())


READING_COLS = ("device_id, gw_timestamp, timestamp_monotonic, timestamp_iso, temperature_sht, humidity, "
                "pressure, light, sound_level, color_hex")


def clean_mask(src: str) -> str:
    return (
        "select device_id, gw_timestamp, timestamp_monotonic, timestamp_iso, temperature_sht, humidity, "
        "case when pressure < 900 then null else pressure end as pressure, "
        "case when light > 70000 then null else light end as light, sound_level, color_hex "
        f"from {src} where gw_timestamp is not null"
    )


def localized(src: str, tz: str = TZ) -> str:
    lt = local("gw_timestamp", tz)
    return (
        f"select *, {lt} as local_ts, cast({lt} as date) as local_date, "
        f"hour({lt}) + minute({lt}) / 60.0 as local_hour, strftime({lt}, '%Y-%m') as local_month, "
        f"cast(hour({lt}) as int) as hour from {src}"
    )


def clean_drop(src: str) -> str:
    return f"select * from {src} where pressure > 500 and light < 1000000"


def offsets(src: str) -> str:
    return (
        "select device_id, cast(12 - arg_min(h, struct_pack(k := -m, h := h)) as int) as inferred_offset from ("
        "select device_id, hour(gw_timestamp) as h, quantile_cont(light, 0.5) as m "
        f"from {src} where gw_timestamp is not null group by all) t where m is not null group by device_id"
    )


def offset_frame(src: str) -> str:
    """fixed-offset frame: offset inferred on valid rows, local time by offset, then clean_drop."""
    lt = "(gw_timestamp + to_hours(inferred_offset))"
    return (
        f"select r.*, o.inferred_offset, {lt} as local_time, cast(hour({lt}) as int) as hour, "
        f"strftime({lt}, '%Y-%m') as month, cast({lt} as date) as date, "
        f"hour({lt}) + minute({lt}) / 60.0 as local_hour "
        f"from {src} r join ({offsets(src)}) o using (device_id) "
        "where r.gw_timestamp is not null and r.pressure > 500 and r.light < 1000000"
    )


def hourly(src: str, tz: str = TZ) -> str:
    """Hourly bins with a per-device spine; ``src`` is a cleaned readings relation."""
    lt = local("s.hour_ts", tz)
    return (
        "select s.device_id, s.hour_ts, a.light, a.temp, a.humidity, a.pressure, a.sound, "
        "coalesce(a.rows, 0) as rows, "
        f"{lt} as local_ts, cast({lt} as date) as local_date, strftime({lt}, '%Y-%m') as local_month, "
        f"cast(hour({lt}) as int) as hour "
        "from (select device_id, unnest(generate_series(min(hour_ts), max(hour_ts), interval 1 hour)) as hour_ts "
        "      from (select device_id, date_trunc('hour', gw_timestamp) as hour_ts from "
        f"{src}) b group by device_id) s "
        "left join (select device_id, date_trunc('hour', gw_timestamp) as hour_ts, "
        "quantile_cont(light, 0.5) as light, quantile_cont(temperature_sht, 0.5) as temp, "
        "quantile_cont(humidity, 0.5) as humidity, quantile_cont(pressure, 0.5) as pressure, "
        f"quantile_cont(sound_level, 0.95) as sound, count(*) as rows from {src} group by all) a "
        "on a.device_id = s.device_id and a.hour_ts = s.hour_ts"
    )


R1 = r1_sql()
R2 = r2_sql()
R3 = r3_sql()
W1 = w1_sql()
RAW_COLOR = raw_color_sql()
RAW_AUDIO = raw_audio_sql()


def base(fixture: str = "r1") -> dict[str, str]:
    """Standard CTE chain: raw -> clean (masked) -> local."""
    raw = {"r1": R1, "r2": R2, "r3": R3}[fixture]
    return {"raw": raw, "clean": clean_mask("raw"), "loc": localized("clean")}
