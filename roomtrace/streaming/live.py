"""Live ingest with Structured Streaming.

``parse_messages``  line-delimited device JSON -> readings (validation, deg C -> deg F, stamping).
``live_pipeline``   file source -> one ``foreachBatch`` that stores readings, feed messages and the
                    bounded newest-N table; each batch overwrites only its own output, so a replayed
                    batch (after a failure) is idempotent.
                    Its versions are committed by markers; the last two are kept.
``live_rollup``     hourly and daily rollups whose moments (count, mean, m2, min, max) each batch merges
                    by key into the stored tables, once a batch id, however late its readings are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtrace.functions.exprs import celsius_to_fahrenheit, instant_from_utc_wall, utc_wall_from_instant
from roomtrace.operators.clean import coerce_numeric
from roomtrace.operators.series import top_n
from roomtrace.schema import READINGS_COLUMNS
from roomtrace.sources.readers import parse_event_time
from roomtrace.sources.sinks import feed_messages

# Every message field is read as text (numbers keep their raw text), then typed leniently.
_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [
    "timestamp_iso", "timestamp_monotonic", "color_hex", "light", "humidity", "temperature_sht", "pressure",
    "sound_level", "device_id"]])


def now_utc_wall() -> Column:
    """Arrival time as a UTC wall time (NTZ), independent of the session zone."""
    return utc_wall_from_instant(F.current_timestamp())


def parse_messages(lines: DataFrame, stamp: Column | None = None, default_device: int = 0) -> DataFrame:
    """``value`` text lines -> readings.

    Blank and non-JSON lines, JSON that is not an object, and objects without
    the ``timestamp_monotonic`` key are dropped; temperature arrives in deg C
    and is stored in deg F (2 digits, half-even); ``gw_timestamp`` is the
    arrival time unless ``stamp`` gives another expression.
    """
    t = F.trim(F.col("value"))
    keys = F.json_object_keys(t)
    ok = (F.length(t) > 0) & F.coalesce(F.array_contains(keys, "timestamp_monotonic"), F.lit(False))
    j = lines.where(ok).select(F.from_json(t, _TEXT_SCHEMA).alias("m"), *(
        [stamp.alias("_stamp")] if stamp is not None else []))
    d = j.select("m.*", *(["_stamp"] if stamp is not None else []))
    d = coerce_numeric(d)
    d = (d.withColumn("temperature_sht", F.when(F.col("temperature_sht").isNotNull(),
                                                celsius_to_fahrenheit("temperature_sht", 2)))
         .withColumn("timestamp_iso", parse_event_time("timestamp_iso"))
         .withColumn("device_id", F.coalesce(F.col("device_id").try_cast("int"), F.lit(default_device)))
         .withColumn("gw_timestamp", F.col("_stamp") if stamp is not None else now_utc_wall()))
    return d.select(*READINGS_COLUMNS)


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed_versions(spark: SparkSession, recent_dir: str) -> list[int]:
    """Versions of the newest-N table that have a marker, ascending."""
    p, fs = _files(spark, f"{recent_dir}/_committed")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def read_recent(spark: SparkSession, recent_dir: str, version: int | None = None) -> DataFrame | None:
    """The newest committed version of the newest-N table, or None before the first commit.  A version that
    is committed but cannot be read raises: it is never taken for an empty table."""
    versions = committed_versions(spark, recent_dir)
    if not versions:
        return None
    return spark.read.parquet(f"{recent_dir}/v={versions[-1] if version is None else version}")


def commit_version(spark: SparkSession, recent_dir: str, version: int, keep: int = 2) -> None:
    """Make a written version the current one by creating its marker (one atomic step), and drop versions
    older than the last ``keep``: first their markers, then their rows."""
    p, fs = _files(spark, f"{recent_dir}/_committed/{version}")
    fs.create(p, True).close()
    for old in committed_versions(spark, recent_dir)[:-keep]:
        for path in (f"{recent_dir}/_committed/{old}", f"{recent_dir}/v={old}"):
            q, fs = _files(spark, path)
            fs.delete(q, True)


def recent_merge(spark: SparkSession, batch: DataFrame, recent_dir: str, batch_id: int, n: int = 300) -> None:
    """Bounded newest-N per device: the last committed version before ``batch_id`` and this batch -> version
    ``batch_id``.  A batch that is run again starts from the same version and writes the same rows."""
    rows = batch.select(*READINGS_COLUMNS)
    before = [v for v in committed_versions(spark, recent_dir) if v < batch_id]
    if before:
        rows = rows.unionByName(read_recent(spark, recent_dir, before[-1]).select(*READINGS_COLUMNS))
    top_n(rows, n, [F.desc("gw_timestamp"), F.desc("timestamp_monotonic"), F.xxhash64(*READINGS_COLUMNS)]).write.mode("overwrite").parquet(
        f"{recent_dir}/v={batch_id}")
    commit_version(spark, recent_dir, batch_id)


def live_pipeline(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, stamp: Column | None = None,
                  recent_n: int = 300, feeds: bool = True, available_now: bool = True, max_files: int | None = None):
    """Text files in ``in_dir`` -> readings store, feed messages and newest-N table under ``out_dir``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    readings = parse_messages(reader.load(in_dir), stamp=stamp)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{out_dir}/store/batch_id={batch_id}")
            if feeds:
                feed_messages(batch).write.mode("overwrite").parquet(f"{out_dir}/feeds/batch_id={batch_id}")
            recent_merge(spark, batch, f"{out_dir}/recent", batch_id, recent_n)
        finally:
            batch.unpersist()

    w = readings.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def live_rollup(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, watermark: str = "24 hours",
                schema: T.StructType | None = None, available_now: bool = True, max_files: int | None = None, distinct: bool = False):
    """Readings Parquet files arriving in ``source_dir`` -> hourly and daily rollups under ``out_dir``.

    A reading counts as often as it arrives, as in the batch rollup.  With ``distinct``, readings equal in all
    columns count once within the watermark, as in a batch rollup of ``dropDuplicates()``; only then the
    stream has state.
    """
    from roomtrace.schema import READINGS_SCHEMA
    from roomtrace.sources.rollups import merge_batch

    reader = spark.readStream.schema(schema or READINGS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    readings = reader.parquet(source_dir)
    if distinct:
        columns = readings.columns
        readings = readings.withColumn("_et", instant_from_utc_wall("gw_timestamp")).withWatermark("_et", watermark)
        readings = readings.dropDuplicatesWithinWatermark(columns).drop("_et")
    w = readings.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, out_dir, batch_id)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 hour")
    return w.start()
