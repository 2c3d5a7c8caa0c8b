"""Time grains: hourly/daily resampling, spines, rollups and the rollup router.

Hourly bins are keyed by the UTC hour start (``hour_ts``) so that the
autumn fall-back hour keeps two bins; local labels are derived after
binning.  The hourly grain's size is devices x hours, independent of the
sampling cadence, which is what makes every sequence operator downstream
(lags, robust z, episodes) cheap at any data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import hour_floor, hour_float, month_str, pct, to_local
from roomtrace.schema import DEFAULT_TZ, NUMERIC_SENSORS


def hour_spine(bins: DataFrame, key: str = "hour_ts", step: str = "1 hour") -> DataFrame:
    """Every bin between each device's first and last bin (device_id, key)."""
    bounds = bins.groupBy("device_id").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    return bounds.select("device_id", F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step}"))).alias(key))


def add_local_labels(df: DataFrame, tz: str = DEFAULT_TZ, key: str = "hour_ts") -> DataFrame:
    lt = to_local(F.col(key), tz)
    return df.withColumns({"local_ts": lt, "local_date": F.to_date(lt), "local_month": month_str(lt),
                           "hour": F.hour(lt)})


def hourly_resample(clean: DataFrame, tz: str = DEFAULT_TZ, spine: bool = True) -> DataFrame:
    """Per device and hour: medians of light, temp, humidity, pressure; p95 sound; row count.

    With ``spine`` every hour between the device's first and last reading is
    present (empty hours: NULL measures, rows = 0), like pandas ``resample``.
    """
    agg = (clean.groupBy("device_id", hour_floor("gw_timestamp").alias("hour_ts"))
           .agg(pct("light", 0.5).alias("light"),
                pct("temperature_sht", 0.5).alias("temp"),
                pct("humidity", 0.5).alias("humidity"),
                pct("pressure", 0.5).alias("pressure"),
                pct("sound_level", 0.95).alias("sound"),
                F.count(F.lit(1)).alias("rows")))
    if spine:
        agg = fill_hours(agg)
    return add_local_labels(agg, tz)


def fill_hours(bins: DataFrame, key: str = "hour_ts") -> DataFrame:
    """Add the empty hours between each device's first and last bin (measures NULL, rows 0).

    ``lead`` over the device's bins (hourly grain, bounded by hours) gives each bin the next one;
    one explode then emits the bin itself followed by the empty hours up to the next bin.  The
    bins are computed once: a union of the bins with gaps derived from them would make Catalyst
    run the aggregation over the raw rows twice (the gap branch prunes to different columns).
    """
    w = Window.partitionBy("device_id").orderBy(key)
    one = F.expr("interval 1 hour")
    d = bins.withColumn("_n", F.lead(key).over(w))
    hours = F.when(F.col("_n") > F.col(key) + one, F.sequence(F.col(key), F.col("_n") - one, one)) \
        .otherwise(F.array(F.col(key)))
    e = d.withColumn("_h", F.explode(hours))
    real = F.col("_h") == F.col(key)
    return e.select(*[F.col("_h").alias(key) if c == key else F.col(c) if c == "device_id" else
                      F.when(real, F.col(c)).otherwise(F.lit(0).cast("bigint") if c == "rows" else
                                                       F.lit(None).cast(t)).alias(c)
                      for c, t in bins.dtypes])


def daily_resample(clean_local: DataFrame) -> DataFrame:
    """Per device and local day: medians of five sensors; days without a pressure median are dropped."""
    return (clean_local.groupBy("device_id", "local_date")
            .agg(pct("pressure", 0.5).alias("pressure"),
                 pct("temperature_sht", 0.5).alias("temp"),
                 pct("humidity", 0.5).alias("humidity"),
                 pct("light", 0.5).alias("light"),
                 pct("sound_level", 0.5).alias("sound"))
            .where(F.col("pressure").isNotNull()))


def long_form(df: DataFrame, sensors=None, keep=("device_id", "gw_timestamp")) -> DataFrame:
    """Wide readings -> (keep..., sensor, value) with NULL values dropped (``EXCLUDE NULLS``)."""
    sensors = list(sensors or NUMERIC_SENSORS)
    sel = df.select(*keep, *[F.col(s).cast("double").alias(s) for s in sensors])
    return (sel.unpivot(list(keep), sensors, "sensor", "value")
            .where(F.col("value").isNotNull()))


_BUCKETS = {
    "hourly": lambda ts: hour_floor(ts),
    "daily": lambda ts: F.window(ts, "1 day").start,
    "monthly": lambda ts: F.to_timestamp_ntz(F.concat(month_str(ts), F.lit("-01 00:00:00"))),
}


def rollup(clean: DataFrame, grain: str = "hourly", sensors=None) -> DataFrame:
    """(device, sensor, bucket) -> avg, min, max, std, count of non-NULL values, plus sum and m2.

    ``sum`` and ``m2`` (sum of squared deviations) let coarser grains and
    ranges merge exactly (``stats_from_rollup``).  Buckets are UTC.
    """
    lf = long_form(clean, sensors)
    b = _BUCKETS[grain](F.col("gw_timestamp"))
    return (lf.groupBy("device_id", "sensor", b.alias("bucket"))
            .agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
                 F.stddev_samp("value").alias("std"), F.count("value").alias("count"),
                 F.sum("value").alias("sum"),
                 (F.var_pop("value") * F.count("value")).alias("m2")))


def rollup_from_rollup(fine: DataFrame, grain: str = "daily") -> DataFrame:
    """Coarsen a rollup by merging moments (no raw rows needed): hourly -> daily -> monthly."""
    b = _BUCKETS[grain](F.col("bucket"))
    merged = (fine.groupBy("device_id", "sensor", b.alias("bucket"))
              .agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"),
                   F.min("min").alias("min"), F.max("max").alias("max"),
                   # m2 = sum(m2_i) + sum(n_i * mean_i^2) - n * mean^2
                   F.sum("m2").alias("_m2"), F.sum(F.col("count") * F.col("avg") * F.col("avg")).alias("_nm2")))
    mean = F.col("sum") / F.col("count")
    m2 = F.greatest(F.col("_m2") + F.col("_nm2") - F.col("count") * mean * mean, F.lit(0.0))
    return merged.select(
        "device_id", "sensor", "bucket", mean.alias("avg"), "min", "max",
        F.when(F.col("count") > 1, F.sqrt(m2 / (F.col("count") - 1))).alias("std"),
        "count", "sum", m2.alias("m2"))


def stats_from_rollup(roll: DataFrame) -> DataFrame:
    """Range statistics from a rollup: weighted mean, unweighted mean of bucket means, min, max, count, std."""
    g = roll.groupBy("device_id", "sensor").agg(
        F.sum("sum").alias("_s"), F.sum("count").alias("count"), F.avg("avg").alias("mean_of_bucket_means"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("m2").alias("_m2"),
        F.sum(F.col("count") * F.col("avg") * F.col("avg")).alias("_nm2"), F.count(F.lit(1)).alias("buckets"))
    mean = F.col("_s") / F.col("count")
    m2 = F.greatest(F.col("_m2") + F.col("_nm2") - F.col("count") * mean * mean, F.lit(0.0))
    return g.select("device_id", "sensor", mean.alias("mean"), "mean_of_bucket_means", "min", "max", "count",
                    F.when(F.col("count") > 1, F.sqrt(m2 / (F.col("count") - 1))).alias("std"), "buckets")


def merge_rollup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key (device, sensor, bucket) is not in ``new``."""
    keys = ["device_id", "sensor", "bucket"]
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def range_rollup(clean: DataFrame, hourly: DataFrame, daily: DataFrame, start, end) -> DataFrame:
    """Rollup rows that cover [start, end) exactly: whole days from the daily rollup, whole hours of the
    first and last day from the hourly one, and the rest of an hour at either edge from raw rows."""
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)

    def floor(t, step):
        zero = dt.datetime(2000, 1, 1)
        return zero + (t - zero) // step * step

    def between(df, col, lo, hi):
        return df.where((F.col(col) >= F.lit(lo.isoformat(" ")).cast("timestamp_ntz")) & (F.col(col) < F.lit(hi.isoformat(" ")).cast("timestamp_ntz")))

    h0, h1 = floor(start + hour - dt.timedelta.resolution, hour), floor(end, hour)
    d0, d1 = floor(start + day - dt.timedelta.resolution, day), floor(end, day)
    parts = []
    if h0 >= h1:
        parts.append(rollup(between(clean, "gw_timestamp", start, end), "hourly"))
    else:
        parts += [rollup(between(clean, "gw_timestamp", lo, hi), "hourly") for lo, hi in ((start, h0), (h1, end)) if lo < hi]
        if d0 < d1:
            parts.append(between(daily, "bucket", d0, d1))
            parts += [between(hourly, "bucket", lo, hi) for lo, hi in ((h0, d0), (d1, h1)) if lo < hi]
        else:
            parts.append(between(hourly, "bucket", h0, h1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rollup_router(span_hours: float, daily_min_hours: float = 24 * 30, hourly_min_hours: float = 48) -> str:
    """Plan-time choice of input: >=30 days -> daily rollup, >=2 days -> hourly, else raw rows."""
    if span_hours >= daily_min_hours:
        return "daily"
    if span_hours >= hourly_min_hours:
        return "hourly"
    return "raw"


def downsample(clean: DataFrame, bucket: str = "15 minutes", sensors=None) -> DataFrame:
    """Cap points for long ranges: per device and bucket, avg/min/max of each sensor."""
    sensors = list(sensors or NUMERIC_SENSORS)
    aggs = []
    for s in sensors:
        aggs += [F.avg(s).alias(f"{s}_avg"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
    return (clean.groupBy("device_id", F.window("gw_timestamp", bucket).start.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("rows"), *aggs))


def local_hour_of(df: DataFrame, ts: str = "local_ts") -> DataFrame:
    return df.withColumn("local_hour", hour_float(ts))
