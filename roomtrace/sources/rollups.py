"""Stored rollups: an hourly and a daily table under one folder, partitioned by date.

``merge_batch``      merge the moments of a batch of readings into both tables, once a batch id.
``refresh_rollups``  recompute the last hours from raw readings (the hourly job) and the days they touch.
``covering_rows``    rollup rows that cover a range exactly: stored days and hours as far as they are
                     final, raw readings for the rest.  The plan reads raw readings of those parts only.
``range_statistics`` statistics of a range through the router.

The rows of a device's newest stored hour may still grow, so a device's *frontier* is the start of that hour
(of its newest day in the daily table): buckets before it are final, everything from it on is read raw.
Arrival times (``gw_timestamp``) grow, so a device that the tables do not know has raw rows behind the oldest
frontier only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.operators.grain import rollup, rollup_from_rollup, rollup_router, stats_from_rollup
from roomtrace.schema import STORE_DATE
from roomtrace.sources.sinks import path_exists, rollup_state, rollup_upsert

KEYS = ["device_id", "sensor", "bucket"]
COLUMNS = [*KEYS, "avg", "min", "max", "std", "count", "sum", "m2"]
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Rollup rows of several tables merged by key: counts, sums and extremes add up, and squared deviations
    are moved to the common mean (``m2 + n * (mean_i - mean)**2``), which loses no digits to cancellation."""
    every = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        every = every.unionByName(p.select(*COLUMNS))
    merged = every.groupBy(*KEYS).agg(
        F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.collect_list(F.struct("count", "avg", "m2")).alias("_parts"))  # one struct a table
    mean = F.col("sum") / F.col("count")
    m2 = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["count"] * (p["avg"] - mean) * (p["avg"] - mean))
    merged = merged.withColumns({"avg": mean, "m2": m2})
    return merged.withColumn("std", F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))).select(*COLUMNS)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket_date", F.to_date("bucket"))


def _put(rows: DataFrame, path: str) -> None:
    """Replace the date partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path)


def merge_batch(readings: DataFrame, root: str, batch_id: int) -> None:
    """Merge a batch of readings into the stored hourly and daily rollups, exactly once a batch id.

    The merged date partitions are first written whole to ``pending/batch_id=N``; only then they replace
    those of the tables.  A batch that is run again finds its pending rows and puts them once more, wherever
    it was stopped, so nothing is merged twice and no partition is lost.  Pending rows go with the next batch.
    """
    spark = readings.sparkSession
    pending = f"{root}/pending/batch_id={batch_id}"
    if not path_exists(spark, f"{pending}/daily/_SUCCESS"):
        delta = rollup(readings, "hourly").persist()
        try:
            dates = [r[0] for r in delta.select(F.to_date("bucket")).distinct().collect()]  # a value a calendar day
            for grain, new in (("hourly", delta), ("daily", rollup_from_rollup(delta, "daily"))):
                path = f"{root}/{grain}"
                if dates and path_exists(spark, path):
                    new = merge_moments(spark.read.parquet(path).where(F.col("bucket_date").isin(dates)), new)
                _dated(new.select(*COLUMNS)).write.mode("overwrite").parquet(f"{pending}/{grain}")
        finally:
            delta.unpersist()
    for grain in ("hourly", "daily"):
        _put(spark.read.parquet(f"{pending}/{grain}"), f"{root}/{grain}")
    drop_path(spark, f"{root}/pending/batch_id={batch_id - 1}")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def build_rollups(readings: DataFrame, root: str) -> str:
    """Write both tables from all readings."""
    _put(_dated(rollup(readings, "hourly")), f"{root}/hourly")
    _put(_dated(rollup_from_rollup(readings.sparkSession.read.parquet(f"{root}/hourly"), "daily")), f"{root}/daily")
    return root


def _join_frontiers(rows: DataFrame, front: DataFrame, how: str) -> DataFrame:
    front = front.withColumnRenamed("device_id", "_device")
    return rows.join(front, F.col("device_id").eqNullSafe(F.col("_device")), how).drop("_device")


def _floor(t: dt.datetime, step: dt.timedelta) -> dt.datetime:
    zero = dt.datetime(2000, 1, 1)
    return zero + (t - zero) // step * step


def _ceil(t: dt.datetime, step: dt.timedelta) -> dt.datetime:
    return _floor(t + step - dt.timedelta.resolution, step)


def _ts(t: dt.datetime):
    return F.lit(t.isoformat(" ")).cast("timestamp_ntz")


def _stored_days(df: DataFrame, *spans) -> DataFrame:
    """A store of readings cut to the date partitions of some spans (``None``: open end)."""
    if STORE_DATE not in df.columns:
        return df
    day, cond = F.col(STORE_DATE), F.lit(False)
    for lo, hi in spans:
        cond = cond | ((day >= F.to_date(_ts(lo))) & (F.lit(True) if hi is None else day <= F.to_date(_ts(hi))))
    return df.where(cond)


def refresh_rollups(readings: DataFrame, root: str, as_of: dt.datetime, hours: int = 24) -> str:
    """Recompute the buckets of the last ``hours`` before ``as_of`` from raw readings, and the days they touch
    from the hourly table."""
    spark = readings.sparkSession
    start = _floor(as_of - dt.timedelta(hours=hours), HOUR)
    recent = _stored_days(readings, (start, None)).where((F.col("gw_timestamp") >= _ts(start)) & (F.col("gw_timestamp") <= _ts(as_of)))
    rollup_upsert(rollup(recent, "hourly"), f"{root}/hourly")
    touched = spark.read.parquet(f"{root}/hourly").where(F.col("bucket_date") >= F.to_date(_ts(start)))
    rollup_upsert(rollup_from_rollup(touched, "daily"), f"{root}/daily")
    return root


def frontiers(spark: SparkSession, root: str) -> DataFrame:
    """``device_id, hour_frontier, day_frontier``: stored buckets before them are final."""
    hours = rollup_state(spark, f"{root}/hourly").withColumnRenamed("last_aggregation", "hour_frontier")
    days = rollup_state(spark, f"{root}/daily").withColumnRenamed("last_aggregation", "day_frontier")
    return _join_frontiers(hours, days, "left")


def covering_rows(readings: DataFrame, root: str, start: dt.datetime, end: dt.datetime, grain: str | None = None) -> DataFrame:
    """Rollup rows that cover [start, end) exactly, as the tables under ``root`` and raw readings allow.

    ``grain``: the coarsest table to use (``daily``, ``hourly``, ``raw``); by default the router's choice
    for the length of the range.
    """
    spark = readings.sparkSession
    grain = grain or rollup_router((end - start).total_seconds() / 3600)
    ts, bucket = F.col("gw_timestamp"), F.col("bucket")
    if grain == "raw" or _ceil(start, HOUR) >= _floor(end, HOUR):
        own = _stored_days(readings, (start, end)).where((ts >= _ts(start)) & (ts < _ts(end)))
        return rollup(own, "hourly").select(*COLUMNS)
    front = frontiers(spark, root)
    h0, h1 = _ceil(start, HOUR), _floor(end, HOUR)
    lowest = front.agg(F.min("hour_frontier")).first()[0] or h0
    lowest = min(max(lowest, h0), h1)

    def within(col, lo, hi):
        return (col >= _ts(lo)) & (col < _ts(hi))

    d0, d1 = _ceil(start, DAY), _floor(end, DAY)
    day = F.to_date(bucket).cast("timestamp_ntz")
    by_day = F.lit(False)
    if grain == "daily" and d0 < d1:
        by_day = within(day, d0, d1) & F.coalesce(day < F.col("day_frontier"), F.lit(False))

    def stored(name: str, lo, hi) -> DataFrame:
        rows = spark.read.parquet(f"{root}/{name}").where(F.col("bucket_date").between(F.to_date(_ts(lo)), F.to_date(_ts(hi))))
        return _join_frontiers(rows.where(within(bucket, lo, hi)), front, "inner").where(bucket < F.col("hour_frontier"))

    parts = [stored("hourly", h0, h1).where(~by_day).select(*COLUMNS)]
    if grain == "daily" and d0 < d1:
        parts.append(stored("daily", d0, d1).where(bucket < F.col("day_frontier")).select(*COLUMNS))
    edges = _stored_days(readings, (start, h0), (lowest, end)).where(within(ts, start, h0) | within(ts, lowest, end))
    edges = _join_frontiers(edges, front.select("device_id", "hour_frontier"), "left")
    edges = edges.where((ts < _ts(h0)) | (ts >= _ts(h1)) | F.coalesce(ts >= F.col("hour_frontier"), F.lit(True)))
    parts.append(rollup(edges, "hourly").select(*COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def range_statistics(readings: DataFrame, root: str, start: dt.datetime, end: dt.datetime, grain: str | None = None) -> DataFrame:
    """Mean, extremes, count and deviation per device and sensor of [start, end), routed over the stored tables."""
    return stats_from_rollup(covering_rows(readings, root, start, end, grain)).select("device_id", "sensor", "mean", "min", "max", "count", "std")
