"""Readers: readings history (CSV / JSON lines / Parquet) and the weather document.

Event time is normalised to a UTC wall time (TIMESTAMP_NTZ): ISO text with
an offset is shifted by that offset with interval arithmetic, naive text is
taken as UTC (as the gateway does), unparseable text becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.functions.exprs import _c, to_utc
from roomtrace.operators.clean import coerce_numeric
from roomtrace.schema import CSV_FIELDNAMES, DEFAULT_TZ, READINGS_COLUMNS

_ISO = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(Z|[+-]\d{2}:?\d{2})?\s*$"


def parse_event_time(text) -> Column:
    """ISO-8601 text -> UTC wall time (NTZ) or NULL."""
    t = _c(text).cast("string")
    wall = F.concat_ws(" ", F.regexp_extract(t, _ISO, 1), F.regexp_extract(t, _ISO, 2)).try_cast("timestamp_ntz")
    off = F.regexp_extract(t, _ISO, 3)
    digits = F.regexp_replace(off, "[^0-9]", "")
    sign = F.when(F.substring(off, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.substring(digits, 1, 2).try_cast("int")
    mm = F.substring(digits, 3, 2).try_cast("int")
    shift = F.make_dt_interval(F.lit(0), sign * hh, sign * mm)
    return F.when(F.length(off) >= 5, wall - shift).otherwise(wall)


def normalize_readings(df: DataFrame, device_id: int | None = None, strict_ints: bool = False) -> DataFrame:
    """Text or loosely typed readings -> canonical schema (missing columns are NULL)."""
    cols = {c: (F.col(c) if c in df.columns else F.lit(None).cast("string")) for c in CSV_FIELDNAMES}
    out = df.select(
        (F.coalesce(F.col("device_id").try_cast("int"), F.lit(device_id or 0)) if "device_id" in df.columns
         else F.lit(device_id or 0).cast("int")).alias("device_id"),
        *[cols[c].cast("string").alias(c) for c in CSV_FIELDNAMES])
    out = (out.withColumn("gw_timestamp", parse_event_time("gw_timestamp"))
           .withColumn("timestamp_iso", parse_event_time("timestamp_iso")))
    out = coerce_numeric(out, strict_ints=strict_ints)
    return out.select(*READINGS_COLUMNS)


def scan_readings(spark: SparkSession, path: str, fmt: str = "csv", device_id: int | None = None,
                  strict_ints: bool = False) -> DataFrame:
    """Read readings history.  CSV/JSON columns are read as text and typed leniently; Parquet is
    expected in the canonical schema (filters and projections push down to the scan)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    elif fmt == "json":
        # a schema of text spares the pass that would infer one
        raw = spark.read.schema(", ".join(f"{c} string" for c in ["device_id", *CSV_FIELDNAMES])).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return normalize_readings(raw, device_id, strict_ints)


WEATHER_FIELDS = ["time", "temperature_2m", "pressure_msl", "precipitation", "rain", "wind_gusts_10m"]


def scan_weather(spark: SparkSession, path: str | None, tz: str = DEFAULT_TZ) -> DataFrame | None:
    """One JSON document of parallel hourly arrays -> rows keyed by the UTC hour.

    Times are naive local times in ``tz``; they are converted to UTC.  The
    document is bounded by the hours it covers.  No path -> None (weather
    sections are skipped, as in the reference).
    """
    if not path:
        return None
    doc = spark.read.option("multiLine", True).json(path)
    arrays = doc.select(*[F.col(f"hourly.{f}").alias(f) for f in WEATHER_FIELDS])
    rows = arrays.select(F.inline(F.arrays_zip(*WEATHER_FIELDS)))
    local = F.col("time").cast("string").try_cast("timestamp_ntz")
    return rows.select(
        to_utc(local, tz).alias("hour_ts"),
        *[F.col(f).cast("double").alias(f) for f in WEATHER_FIELDS[1:]])
