"""Schemas, sensor names and the time-range token table."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference: the stored CSV column order.
CSV_FIELDNAMES = [
    "gw_timestamp",
    "timestamp_monotonic",
    "timestamp_iso",
    "temperature_sht",
    "humidity",
    "pressure",
    "light",
    "sound_level",
    "color_hex",
]

# The valid sensor names; every one but color_hex is numeric.
VALID_SENSORS = ["temperature_sht", "humidity", "pressure", "light", "sound_level", "color_hex"]
NUMERIC_SENSORS = ["temperature_sht", "humidity", "pressure", "light", "sound_level"]

DEFAULT_TZ = "America/Chicago"

READINGS_SCHEMA = T.StructType(
    [
        T.StructField("device_id", T.IntegerType()),
        T.StructField("gw_timestamp", T.TimestampNTZType()),
        T.StructField("timestamp_monotonic", T.DoubleType()),
        T.StructField("timestamp_iso", T.TimestampNTZType()),
        T.StructField("temperature_sht", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("light", T.LongType()),
        T.StructField("sound_level", T.LongType()),
        T.StructField("color_hex", T.StringType()),
    ]
)
READINGS_COLUMNS = [f.name for f in READINGS_SCHEMA.fields]

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("hour_ts", T.TimestampNTZType()),  # UTC hour start
        T.StructField("temperature_2m", T.DoubleType()),  # deg C
        T.StructField("pressure_msl", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("rain", T.DoubleType()),
        T.StructField("wind_gusts_10m", T.DoubleType()),
    ]
)

# Device message: the readings keys minus gw_timestamp, temperature in deg C.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_iso", T.StringType()),
        T.StructField("timestamp_monotonic", T.DoubleType()),
        T.StructField("color_hex", T.StringType()),
        T.StructField("light", T.LongType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("temperature_sht", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("sound_level", T.LongType()),
        T.StructField("device_id", T.IntegerType()),
    ]
)

# live/history range tokens -> hours back from as_of (None = no filter).
RANGE_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 24 * 7, "30d": 24 * 30, "all": None}
# Our mapping for the selectors that the plans pass through unmapped.
EXTRA_RANGE_HOURS = {"1m": 24 * 30, "3m": 24 * 90, "6m": 24 * 180, "90d": 24 * 90, "28d": 24 * 28,
                     "56d": 24 * 56, "180d": 24 * 180, "4w": 24 * 28, "8w": 24 * 56}
# Heat-map period selector -> range token; unknown -> 28d.
PERIOD_MAP = {"4w": "28d", "8w": "56d", "3m": "90d", "6m": "180d", "all": "all"}

# The feed names that one reading fans out to.
FEED_KEYS = {
    "temperature_sht": "temperature-sht",
    "humidity": "humidity",
    "pressure": "pressure",
    "light": "light",
    "sound_level": "sound-level",
    "color_hex": "color-hex",
}

# date of a reading's UTC time: partition column of the Parquet store
STORE_DATE = "reading_date"
