"""Time-range tokens, localisation and calendar columns."""

from __future__ import annotations

import datetime as _dt
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtrace.functions.exprs import hour_float, month_str, to_local
from roomtrace.schema import DEFAULT_TZ, EXTRA_RANGE_HOURS, PERIOD_MAP, RANGE_HOURS, STORE_DATE


def range_hours(token) -> int | None:
    """Hours back from ``as_of`` for a token; ``all``/None -> None; unknown -> 1 (the live default, with a warning)."""
    if token is None:
        return None
    if token in RANGE_HOURS:
        return RANGE_HOURS[token]
    if token in EXTRA_RANGE_HOURS:
        return EXTRA_RANGE_HOURS[token]
    warnings.warn(f"unknown time range {token!r}: the last hour is taken", stacklevel=3)
    return 1


def period_map(period: str) -> str:
    """Heat-map period selector -> range token; unknown selectors give 28 days."""
    return PERIOD_MAP.get(period, "28d")


def _lit_ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        v = _dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    if isinstance(v, _dt.datetime) and v.tzinfo is not None:
        v = v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    # A Python datetime literal would become a zone-dependent TIMESTAMP; text casts straight to NTZ.
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def time_range(df: DataFrame, token=None, as_of=None, ts_col: str = "gw_timestamp") -> DataFrame:
    """Filter rows by a range token (``1h``…``30d``, ``all``) or ``{"start", "end"}`` (half-open).

    ``as_of`` is explicit (a literal keeps the filter pushed down to the
    Parquet scan).  When omitted, it is each device's newest reading, taken
    from a one-row-per-device aggregate joined back on ``device_id``.
    A frame read from the Parquet store is also filtered by its date partitions, without ``as_of`` by those that
    its partition values say can hold the range.
    """
    ts = F.col(ts_col)
    stored = ts_col == "gw_timestamp" and STORE_DATE in df.columns
    if isinstance(token, dict):
        cond = F.lit(True)
        if token.get("start") is not None:
            cond = cond & (ts >= _lit_ts(token["start"]))
            cond = cond & (F.col(STORE_DATE) >= F.to_date(_lit_ts(token["start"]))) if stored else cond
        if token.get("end") is not None:
            cond = cond & (ts < _lit_ts(token["end"]))
            cond = cond & (F.col(STORE_DATE) <= F.to_date(_lit_ts(token["end"]))) if stored else cond
        return df.where(cond)
    hours = range_hours(token)
    if hours is None:
        return df
    if as_of is not None:
        start = _lit_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
        return df.where((ts >= start) & (F.col(STORE_DATE) >= F.to_date(start)) if stored else ts >= start)
    from roomtrace.operators.joins import join_small

    if stored:
        # the newest day of each device is a partition value; the smallest of them bounds the days to read, as a
        # scalar subquery that the scan's partition filter takes
        days = df.groupBy("device_id").agg(F.max(STORE_DATE).alias("_d"))
        df = df.where(F.col(STORE_DATE) >= days.agg(F.date_sub(F.min("_d"), -(-hours // 24))).scalar())
    newest = df.groupBy("device_id").agg(F.max(ts_col).alias("_as_of"))
    return (join_small(df, newest, "device_id")
            .where(ts >= F.col("_as_of") - F.make_dt_interval(F.lit(0), F.lit(hours)))
            .drop("_as_of"))


def localize(df: DataFrame, tz: str = DEFAULT_TZ, ts_col: str = "gw_timestamp") -> DataFrame:
    """Add local wall time and its labels: local_ts, local_date, local_hour (h + min/60), local_month, hour."""
    lt = to_local(F.col(ts_col), tz)
    return df.withColumns({"local_ts": lt, "local_date": F.to_date(lt), "local_hour": hour_float(lt),
                           "local_month": month_str(lt), "hour": F.hour(lt)})


def calendar_cols(df: DataFrame, ts_col: str = "local_ts") -> DataFrame:
    """hour, date, YYYY-MM, day of week (Mon=0), weekend flag, day of month."""
    t = F.col(ts_col)
    return (df.withColumn("cal_hour", F.hour(t))
            .withColumn("cal_date", F.to_date(t))
            .withColumn("cal_month", month_str(t))
            .withColumn("dow", F.weekday(t))
            .withColumn("is_weekend", F.weekday(t) >= 5)
            .withColumn("day_of_month", F.dayofmonth(t)))
