"""Data profile and provenance: schema summaries, quality flags, recent rows.

Profiles are one wide aggregate per device and hour, stacked into one row per
column with ``explode(array(struct...))`` (no join, no driver loop) and merged.
Examples ("first values") come from a per-(device, column) top-n, which
Spark limits partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtrace.functions.exprs import hour_floor, pct, seconds_between, to_local
from roomtrace.operators.series import device_reboots, top_gaps, top_n
from roomtrace.schema import CSV_FIELDNAMES, NUMERIC_SENSORS

_NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType)
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _cols(df: DataFrame, columns=None):
    return [c for c in (columns or CSV_FIELDNAMES) if c in df.columns]


def _value_text(df: DataFrame, c: str):
    """Text of a value, the same for equal values (-0.0 is 0.0)."""
    kind = df.schema[c].dataType
    v = F.col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)
    return v.cast("string")


def _profiled(df: DataFrame, cols: list[str], ts: str) -> DataFrame:
    """Per device and column (``position``): rows, non-NULL values, distinct values, first example, values that
    read as numbers with their range, and the range of times.

    Distinct values merge without an Expand of the raw rows: values are collected map-side as sets per device and
    hour, of which the event times are counted as they are (hours are disjoint); the others go on as the few
    values of an hour, once each, to be counted over all hours.  One read of ``df``; no task holds a device.
    """
    cells, aggs = [], [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        text = _value_text(df, c)
        number = text.try_cast("double")
        timed = isinstance(df.schema[c].dataType, _TIME_TYPES)
        when = F.col(c).cast("timestamp_ntz") if timed else F.lit(None).cast("timestamp_ntz")
        aggs += [F.count(c).alias(f"_n{i}"), F.count(number).alias(f"_u{i}"), F.min(number).alias(f"_a{i}"), F.max(number).alias(f"_z{i}"),
                 F.min(when).alias(f"_f{i}"), F.max(when).alias(f"_l{i}"), F.collect_set(text).alias(f"_s{i}"),
                 F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).cast("string").alias("v")))).alias(f"_e{i}")]
        own = c == ts
        cells.append(F.struct(
            F.lit(i).alias("position"), F.col("_rows").alias("rows"), *[F.col(f"_{k}{i}").alias(n) for k, n in zip("nuazfle", (
                "n", "numbers", "least", "most", "first", "last", "example"))],
            (F.size(f"_s{i}") if own else F.lit(0)).cast("long").alias("counted"),
            (F.array().cast("array<string>") if own else F.col(f"_s{i}")).alias("values")))
    hours = df.groupBy("device_id", hour_floor(ts).alias("_hour")).agg(*aggs)
    cell = hours.select("device_id", F.explode(F.array(*cells)).alias("c")).select("device_id", "c.*")
    each = cell.select(*[c for c in cell.columns if c != "values"], F.posexplode_outer("values").alias("_k", "value"))
    here = F.coalesce(F.col("_k"), F.lit(0)) == 0  # the numbers of an hour go with its first value
    parts = {"rows": F.sum, "n": F.sum, "numbers": F.sum, "counted": F.sum, "least": F.min, "most": F.max, "first": F.min, "last": F.max, "example": F.min}
    by_value = each.groupBy("device_id", "position", "value").agg(*[f(F.when(here, F.col(c))).alias(c) for c, f in parts.items()])
    return by_value.groupBy("device_id", "position").agg(*[f(c).alias(c) for c, f in parts.items()], F.count("value").alias("values")) \
        .withColumn("distinct", F.col("values") + F.col("counted"))


def schema_profile(df: DataFrame, columns=None, approx: bool = False, ts: str = "gw_timestamp") -> DataFrame:
    """Per device and column: type, null rate, distinct non-NULL count, first example, min/max.

    ``approx`` counts distinct values by HyperLogLog sketches, in one aggregate.
    """
    cols = _cols(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    at = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.struct(
        F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("type"), F.lit(isinstance(types[c], _NUMERIC_TYPES)).alias("num")))])
    if approx:
        g = _approx_profile(df, cols, ts)
    else:
        g = _profiled(df, cols, ts)
    g = g.withColumn("_c", F.element_at(at, F.col("position")))
    return g.select("device_id", "position", "_c.column", "_c.type", ((F.col("rows") - F.col("n")) / F.col("rows")).alias("null_rate"),
                    F.col("distinct").alias("unique_count"), F.col("example.v").alias("example"),
                    F.when(F.col("_c.num"), F.col("least")).alias("min_value"), F.when(F.col("_c.num"), F.col("most")).alias("max_value"),
                    F.col("first").alias("min_time"), F.col("last").alias("max_time"))


def _approx_profile(df: DataFrame, cols: list[str], ts: str) -> DataFrame:
    aggs, cells = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(cols):
        timed = isinstance(df.schema[c].dataType, _TIME_TYPES)
        number = _value_text(df, c).try_cast("double")
        when = F.col(c).cast("timestamp_ntz") if timed else F.lit(None).cast("timestamp_ntz")
        aggs += [F.count(c).alias(f"_n{i}"), F.approx_count_distinct(c).alias(f"_d{i}"), F.min(number).alias(f"_a{i}"), F.max(number).alias(f"_z{i}"),
                 F.min(when).alias(f"_f{i}"), F.max(when).alias(f"_l{i}"),
                 F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).cast("string").alias("v")))).alias(f"_e{i}")]
        cells.append(F.struct(F.lit(i).alias("position"), F.col("_rows").alias("rows"), *[F.col(f"_{k}{i}").alias(n) for k, n in zip("ndazfle", (
            "n", "distinct", "least", "most", "first", "last", "example"))]))
    return df.groupBy("device_id").agg(*aggs).select("device_id", F.explode(F.array(*cells)).alias("c")).select("device_id", "c.*")


def column_summary(df: DataFrame, columns=None, ts: str = "gw_timestamp", n_examples: int = 3) -> DataFrame:
    """Per device and column: null % (3 digits), distinct, first 3 examples, and a kind:
    ``datetime`` for the event time, ``numeric`` when at least max(3, 50 %) of the rows
    read as numbers, else ``categorical``; min/max for datetime and numeric columns."""
    cols = _cols(df, columns)
    g = _profiled(df, cols, ts)
    long = df.select("device_id", F.col(ts).alias("_t"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])).alias("x")).select("device_id", "_t", "x.*")
    ex = (top_n(long.where(F.col("v").isNotNull()), n_examples, [F.asc("_t"), F.asc("v")], part=("device_id", "position"))
          .groupBy("device_id", "position")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "v"))), lambda s: s["v"]), ", ")
               .alias("examples")))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("position") + 1)
    kind = (F.when(name == ts, "datetime")
            .when((F.col("numbers") > 0) & (F.col("numbers") >= F.greatest(F.lit(3.0), F.col("rows") * 0.5)), "numeric")
            .otherwise("categorical"))
    g = g.withColumns({"column": name, "type": kind})
    return (g.join(ex, ["device_id", "position"], "left")
            .select("device_id", "position", "column",
                    F.round((F.col("rows") - F.col("n")) / F.col("rows") * 100, 3).alias("null_rate"),
                    F.col("distinct").alias("unique_nonnull"), "examples", "type",
                    F.when(F.col("type") == "numeric", F.col("least")).alias("min"),
                    F.when(F.col("type") == "numeric", F.col("most")).alias("max"),
                    F.when(F.col("type") == "datetime", F.col("first")).alias("date_min"),
                    F.when(F.col("type") == "datetime", F.col("last")).alias("date_max")))


def quality_flags(df: DataFrame, columns=None) -> DataFrame:
    """Duplicate rows (all stored columns equal, NULLs equal), temperature < 0, light = 0, sound > 100."""
    cols = ["device_id"] + [c for c in _cols(df, columns) if c != "device_id"]
    dups = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("device_id").agg(F.sum(F.col("_c") - 1).alias("duplicate_rows")))
    flags = df.groupBy("device_id").agg(
        F.count_if(F.col("temperature_sht") < 0).alias("negative_temperature"),
        F.count_if(F.col("light") == 0).alias("zero_light"),
        F.count_if(F.col("sound_level") > 100).alias("high_sound"))
    return flags.join(dups, "device_id")


def provenance(raw: DataFrame, cleaned: DataFrame, tz: str = "America/Chicago",
               pressure_min: float = 900.0, light_max: int = 70000) -> DataFrame:
    """One row per device: source rows, kept rows, UTC and local ranges, rows with any NULL sensor, audit counts."""
    sensors = NUMERIC_SENSORS + ["color_hex"]
    anynull = F.lit(False)
    for s in sensors:
        anynull = anynull | F.col(s).isNull()
    a = raw.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col("gw_timestamp").isNull()).alias("invalid_gw_timestamp"),
        F.count_if(F.col("pressure") < pressure_min).alias("pressure_lt_900_hpa"),
        F.count_if(F.col("light") > light_max).alias("light_gt_70000_clear_counts"),
        F.count_if(F.col("timestamp_monotonic").isNull()).alias("corrupt_monotonic_non_numeric"))
    b = cleaned.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("rows_after_timestamp_cleaning"),
        F.min("gw_timestamp").alias("utc_start"), F.max("gw_timestamp").alias("utc_end"),
        F.count_if(anynull).alias("rows_with_any_null_sensor"))
    return (a.join(b, "device_id", "left")
            .withColumn("local_start", to_local("utc_start", tz)).withColumn("local_end", to_local("utc_end", tz)))


def provenance_events(gaps: DataFrame, n_gaps: int = 8, n_reboots: int = 12, min_gap_s: float = 3600) -> DataFrame:
    """What provenance lists of a device's record: its longest gaps (longest first) and its first reboots."""
    reboot = device_reboots(gaps, n_reboots).select("device_id", F.lit("reboot").alias("kind"), "gw_timestamp", F.col("mono_gap_s").alias("seconds"))
    gap = top_gaps(gaps, n_gaps, min_gap_s).select("device_id", F.lit("gap").alias("kind"), "gw_timestamp", F.col("gw_gap_s").alias("seconds"))
    w = Window.partitionBy("device_id", "kind").orderBy(F.when(F.col("kind") == "gap", -F.col("seconds")), "gw_timestamp")
    return gap.unionByName(reboot).withColumn("place", F.row_number().over(w))


def provenance_record(raw: DataFrame, cleaned: DataFrame, gaps: DataFrame, tz: str = "America/Chicago") -> DataFrame:
    """``provenance`` with the arrays ``major_gaps`` and ``device_reboots``, a row per device (for the payload)."""
    ev = provenance_events(gaps)

    def listed(kind: str) -> F.Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "gw_timestamp", "seconds"))))
        return F.transform(rows, lambda x: F.struct(x["gw_timestamp"].alias("gw_timestamp"), x["seconds"].alias("seconds")))

    lists = ev.groupBy("device_id").agg(listed("gap").alias("major_gaps"), listed("reboot").alias("device_reboots"))
    nothing = F.array().cast("array<struct<gw_timestamp:timestamp_ntz,seconds:double>>")
    out = provenance(raw, cleaned, tz).join(lists, "device_id", "left")
    return out.withColumns({c: F.coalesce(c, nothing) for c in ("major_gaps", "device_reboots")})


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return top_n(df, n, [F.asc("gw_timestamp")])


def recent_readings(df: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` rows per device (newest first when ordered by ``recent_rank``)."""
    from pyspark.sql import Window

    w = Window.partitionBy("device_id").orderBy(F.desc("gw_timestamp"))
    return df.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)


def latest_reading(df: DataFrame) -> DataFrame:
    """The newest row of each device (a per-device ``max(struct(ts, ...))``)."""
    cols = [c for c in df.columns if c not in ("device_id", "gw_timestamp")]
    m = df.groupBy("device_id").agg(F.max(F.struct("gw_timestamp", *cols)).alias("_r"))
    return m.select("device_id", "_r.*")


def chart_series(df: DataFrame) -> DataFrame:
    """Typed chart columns: labels plus five numeric series; light and sound need integer text."""
    return df.select(
        "device_id", "gw_timestamp", F.col("temperature_sht").cast("double").alias("temperature"),
        F.col("humidity").cast("double").alias("humidity"), F.col("pressure").cast("double").alias("pressure"),
        F.col("light").cast("string").try_cast("bigint").alias("light"),
        F.col("sound_level").cast("string").try_cast("bigint").alias("sound"))


def span_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(
        (seconds_between(F.max("gw_timestamp"), F.min("gw_timestamp")) / 3600.0).alias("span_hours"),
        pct("temperature_sht", 0.5).alias("median_temp"))
