"""Sinks: stored history, exports, analysis sections, rollup tables, feed messages.

Writers are plain DataFrame writes; nothing passes through the driver.
Re-runnable writes are idempotent: rollups are merged by key within the date
partitions they touch (dynamic partition overwrite), streaming batches overwrite
their own batch partition.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.functions.exprs import iso_str
from roomtrace.functions.timefn import range_hours, time_range
from roomtrace.operators.anomalies import moving_average, zscore
from roomtrace.operators.clean import project_sensors
from roomtrace.operators.grain import merge_rollup
from roomtrace.plans.present import present
from roomtrace.schema import CSV_FIELDNAMES, FEED_KEYS, NUMERIC_SENSORS, STORE_DATE
from roomtrace.session import checkpoint_dir


def _as_text(df: DataFrame) -> DataFrame:
    """Timestamps and dates as ISO text; numbers as they are."""
    return present(df, digits=None)


def as_csv_rows(df: DataFrame) -> DataFrame:
    """The stored column list (extra columns dropped), timestamps as ISO text with a UTC offset."""
    cols = []
    for c in CSV_FIELDNAMES:
        if c not in df.columns:
            cols.append(F.lit(None).cast("string").alias(c))
        elif c in ("gw_timestamp", "timestamp_iso"):
            cols.append(F.when(F.col(c).isNotNull(), F.concat(iso_str(c, sep="T"), F.lit("+00:00"))).alias(c))
        else:
            cols.append(F.col(c))
    keep = [F.col("device_id")] if "device_id" in df.columns else []
    return df.select(*keep, *cols)


def sink_append(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("device_id", STORE_DATE)) -> None:
    """Append readings to the store: CSV with header per file, or Parquet partitioned by device and date of
    the UTC time (``reading_date``), so that time ranges read only their days."""
    w = as_csv_rows(df) if fmt == "csv" else df
    if fmt != "csv" and STORE_DATE in partition_by:
        w = w.withColumn(STORE_DATE, F.to_date("gw_timestamp"))
    writer = w.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*[p for p in partition_by if p in w.columns])
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def recent_days(df: DataFrame, hours: int | None) -> DataFrame:
    """Rows of the days that "the last ``hours`` of each device" can touch.  Only partition values are read
    to find them: no device's range begins earlier than ``hours`` before the smallest of the newest days."""
    if hours is None or STORE_DATE not in df.columns:
        return df
    first = df.groupBy("device_id").agg(F.max(STORE_DATE).alias("d")).agg(F.min("d")).first()[0]
    return df if first is None else df.where(F.col(STORE_DATE) >= F.lit(first - timedelta(days=-(-hours // 24))))


def export_range(df: DataFrame, path: str, token="24h", as_of=None) -> str:
    """CSV of one time range with the stored columns; raises when the range is empty."""
    if as_of is None and not isinstance(token, dict):
        df = recent_days(df, range_hours(token))
    rows = time_range(df, token, as_of)
    if rows.isEmpty():
        raise ValueError("No data in the selected time range")
    as_csv_rows(rows).write.mode("overwrite").option("header", True).csv(path)
    return path


def export_all(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Copy the whole history (CSV with the stored columns, or Parquet)."""
    if fmt == "csv":
        as_csv_rows(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def sink_parquet(df: DataFrame, path: str, partition_by=()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_selected(df: DataFrame, path: str, sensors, token=None, as_of=None, with_zscore: bool = False,
                    moving_avg_s: int | None = None) -> str:
    """CSV of chosen sensors over a range, optionally with z-score and moving-average columns."""
    d = project_sensors(time_range(df, token, as_of) if token else df, list(sensors))
    for s in sensors:
        if with_zscore and s in NUMERIC_SENSORS:
            d = zscore(d, s)
        if moving_avg_s and s in NUMERIC_SENSORS:
            d = moving_average(d, s, window_s=moving_avg_s)
    _as_text(d).write.mode("overwrite").option("header", True).csv(path)
    return path


def export_json(df: DataFrame, out_dir: str, sensors=None, token=None, as_of=None, stats: DataFrame | None = None,
                insights: DataFrame | None = None) -> str:
    """JSON export as four datasets under one directory: metadata, statistics, data, insights."""
    sensors = list(sensors or NUMERIC_SENSORS)
    d = project_sensors(time_range(df, token, as_of) if token else df, sensors)
    meta = d.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("gw_timestamp").alias("start"), F.max("gw_timestamp").alias("end"),
    ).withColumn("sensors", F.lit(",".join(sensors))).withColumn("time_range", F.lit(str(token)))
    _as_text(meta).write.mode("overwrite").json(f"{out_dir}/metadata")
    _as_text(d).write.mode("overwrite").json(f"{out_dir}/data")
    if stats is not None:
        _as_text(stats).write.mode("overwrite").json(f"{out_dir}/statistics")
    if insights is not None:
        _as_text(insights).write.mode("overwrite").json(f"{out_dir}/insights")
    return out_dir


def sink_sections(sections: dict[str, DataFrame], out_dir: str) -> str:
    """The analysis payload: one small JSON dataset per section, timestamps as ISO text."""
    for name, frame in sections.items():
        _as_text(frame).write.mode("overwrite").json(f"{out_dir}/{name}")
    return out_dir


def export_anomaly_report(anoms: DataFrame, path: str) -> str:
    """CSV: timestamp, sensor, value, z, severity, expected value, absolute deviation."""
    rep = anoms.select("device_id", F.col("gw_timestamp").alias("timestamp"), "sensor", "value", "z_score", "severity",
                       F.col("expected_value"), F.abs(F.col("value") - F.col("expected_value")).alias("abs_deviation"))
    _as_text(rep).write.mode("overwrite").option("header", True).csv(path)
    return path


def export_stats(stats: DataFrame, path: str, fmt: str = "csv") -> str:
    p = _as_text(stats).write.mode("overwrite")
    (p.option("header", True).csv(path) if fmt == "csv" else p.json(path))
    return path


def rollup_upsert(roll: DataFrame, path: str) -> str:
    """Insert-or-replace rollup rows by key (device, sensor, bucket).  Only the date partitions that
    ``roll`` touches are read, merged and overwritten; their other rows stay.  The merged rows are cut
    from the files they replace by a reliable checkpoint before these are overwritten."""
    spark = roll.sparkSession
    checkpoint_dir(spark)
    new = roll.withColumn("bucket_date", F.to_date("bucket"))
    if path_exists(spark, path):
        new = new.checkpoint()  # evaluated once: the dates read and the rows written belong together
        dates = [r[0] for r in new.select("bucket_date").distinct().collect()]  # a value a calendar day
        old = spark.read.parquet(path).where(F.col("bucket_date").isin(dates)).select(*new.columns)
        new = merge_rollup(old, new).checkpoint()
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rollup_state(spark: SparkSession, path: str) -> DataFrame:
    """Last aggregated bucket per device (the batch counterpart of a streaming checkpoint)."""
    return spark.read.parquet(path).groupBy("device_id").agg(F.max("bucket").alias("last_aggregation"))


def feed_messages(df: DataFrame, feed_keys: dict | None = None) -> DataFrame:
    """Fan one wide reading out into (feed_key, value) messages, non-NULL values only."""
    keys = feed_keys or FEED_KEYS
    cols = [c for c in keys if c in df.columns]
    sel = df.select("device_id", "gw_timestamp", *[F.col(c).cast("string").alias(c) for c in cols])
    m = F.create_map(*[x for k in cols for x in (F.lit(k), F.lit(keys[k]))])
    return (sel.unpivot(["device_id", "gw_timestamp"], cols, "sensor", "value")
            .where(F.col("value").isNotNull())
            .withColumn("feed_key", F.element_at(m, F.col("sensor"))))


def sink_feeds(df: DataFrame, path: str, feed_keys: dict | None = None) -> str:
    feed_messages(df, feed_keys).write.mode("append").partitionBy("feed_key").parquet(path)
    return path
