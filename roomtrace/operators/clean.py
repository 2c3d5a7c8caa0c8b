"""Cleaning, coercion, localisation by inferred offset, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.functions.exprs import hour_float, month_str, nan_to_null, pct
from roomtrace.schema import NUMERIC_SENSORS, READINGS_COLUMNS, VALID_SENSORS


def skip_malformed(df: DataFrame, ts_col: str = "gw_timestamp") -> DataFrame:
    """Drop rows whose event time did not parse."""
    return df.where(F.col(ts_col).isNotNull())


def coerce_numeric(df: DataFrame, strict_ints: bool = False) -> DataFrame:
    """Text columns -> numbers or NULL (``errors='coerce'``); NaN text becomes NULL too.

    ``strict_ints`` follows the live gateway, which needs integer text for
    light and sound (``'123.0'`` -> NULL); the default accepts decimals.
    """
    out = df
    for c in ["timestamp_monotonic", "temperature_sht", "humidity", "pressure"]:
        if c in df.columns:
            out = out.withColumn(c, nan_to_null(F.col(c).cast("string").try_cast("double")))
    for c in ["light", "sound_level"]:
        if c in df.columns:
            txt = F.col(c).cast("string")
            v = (txt.try_cast("bigint") if strict_ints
                 else nan_to_null(txt.try_cast("double")).try_cast("bigint"))
            out = out.withColumn(c, v)
    return out


def clean_drop(df: DataFrame) -> DataFrame:
    """Keep ``pressure > 500 AND light < 1,000,000``; a NULL in either drops the row."""
    return df.where((F.col("pressure") > 500) & (F.col("light") < 1000000))


def clean_mask(df: DataFrame, pressure_min: float = 900.0, light_max: int = 70000) -> DataFrame:
    """Mask implausible cells to NULL (pressure < 900, light > 70000) and drop rows without time."""
    return (df.where(F.col("gw_timestamp").isNotNull())
            .withColumns({"pressure": F.when(~(F.col("pressure") < pressure_min) | F.col("pressure").isNull(),
                                             F.col("pressure")),
                          "light": F.when(~(F.col("light") > light_max) | F.col("light").isNull(), F.col("light"))}))


def clean_audit(df: DataFrame, pressure_min: float = 900.0, light_max: int = 70000) -> DataFrame:
    """Per device, counted before masking: invalid time, low pressure, high light, corrupt uptime."""
    return df.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col("gw_timestamp").isNull()).alias("invalid_gw_timestamp"),
        F.count_if(F.col("pressure") < pressure_min).alias("pressure_lt_900_hpa"),
        F.count_if(F.col("light") > light_max).alias("light_gt_70000_clear_counts"),
        F.count_if(F.col("timestamp_monotonic").isNull()).alias("corrupt_monotonic_non_numeric"),
    )


def project_sensors(df: DataFrame, sensors: list[str], keep=("device_id", "gw_timestamp")) -> DataFrame:
    """Select sensors by name; unknown names raise (the engine's whitelist)."""
    bad = [s for s in sensors if s not in VALID_SENSORS]
    if bad:
        raise ValueError(f"invalid sensor(s): {bad}; valid: {VALID_SENSORS}")
    return df.select(*keep, *sensors)


def normalize_device(df: DataFrame) -> DataFrame:
    """Device-side normalisation: floats rounded half-even to 2 digits; clock valid only after 2000."""
    out = df
    for c in ["temperature_sht", "humidity", "pressure", "timestamp_monotonic"]:
        if c in df.columns:
            out = out.withColumn(c, F.bround(F.col(c), 2))
    if "timestamp_iso" in df.columns:
        out = out.withColumn("timestamp_iso", F.when(F.year("timestamp_iso") > 2000, F.col("timestamp_iso")))
    return out


def infer_utc_offset(df: DataFrame) -> DataFrame:
    """Per device: 12 minus the UTC hour with the highest median light (first hour wins ties).

    Two small aggregates: (device, hour) medians, then one arg-max per device.
    """
    med = (df.where(F.col("gw_timestamp").isNotNull())
           .groupBy("device_id", F.hour("gw_timestamp").alias("hour_utc"))
           .agg(pct("light", 0.5).alias("m")))
    best = (med.where(F.col("m").isNotNull()).groupBy("device_id")
            .agg(F.min(F.struct((-F.col("m")).alias("k"), F.col("hour_utc").alias("h"))).alias("b")))
    return best.select("device_id", (F.lit(12) - F.col("b.h")).cast("int").alias("inferred_offset"))


def apply_offset(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Local time = UTC + inferred offset; adds local_time, hour, month, date.

    ``offsets`` has one row per device.
    """
    lt = F.col("gw_timestamp") + F.make_dt_interval(F.lit(0), F.col("inferred_offset"))
    from roomtrace.operators.joins import join_small

    return (join_small(df, offsets, "device_id")
            .withColumns({"local_time": lt, "hour": F.hour(lt), "month": month_str(lt), "date": F.to_date(lt),
                          "local_hour": hour_float(lt)}))


def offset_frame(readings: DataFrame) -> DataFrame:
    """The fixed-offset frame: offset inferred before cleaning, then ``clean_drop``."""
    valid = skip_malformed(readings)
    return clean_drop(apply_offset(valid, infer_utc_offset(valid)))


def typed_readings(df: DataFrame) -> DataFrame:
    """Canonical column order and types."""
    cols = [c for c in READINGS_COLUMNS if c in df.columns]
    return df.select(*cols)


SENSOR_COLUMNS = NUMERIC_SENSORS + ["color_hex"]
