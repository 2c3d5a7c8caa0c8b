"""Color operators: parsed channels, monthly regimes, timelines, top colors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions import exprs as X
from roomtrace.operators.series import top_n


def color_frame(loc: DataFrame) -> DataFrame:
    """Rows with a valid ``#RRGGBB`` color, with r, g, b, brightness, warm_cool and mode."""
    c = F.col("color_hex")
    return (loc.where(X.hex_valid(c))
            .withColumn("r", X.hex_channel(c, 0)).withColumn("g", X.hex_channel(c, 1))
            .withColumn("b", X.hex_channel(c, 2))
            .withColumn("brightness", X.brightness("r", "g", "b"))
            .withColumn("warm_cool", X.warm_cool("r", "b"))
            .withColumn("color_mode", X.color_mode("brightness", "warm_cool")))


MODES = ["dark", "warm", "cool", "neutral"]


def blend_color(frame: DataFrame, keys, first_n: int | None = None, order: str = "gw_timestamp") -> DataFrame:
    """Per group: mean RGB of all valid colors (or of the first ``first_n``), rounded half-even, clipped, as hex."""
    first = frame if first_n is None else top_n(frame, first_n, [F.asc(order)], part=keys)

    def ch(c):
        return F.least(F.greatest(F.bround(F.avg(c), 0), F.lit(0.0)), F.lit(255.0)).cast("int")

    return (first.groupBy(*keys).agg(ch("r").alias("_r"), ch("g").alias("_g"), ch("b").alias("_b"))
            .select(*keys, F.format_string("#%02X%02X%02X", "_r", "_g", "_b").alias("dominant_color")))


def monthly_color_modes(frame: DataFrame) -> DataFrame:
    """month -> share of each mode (0 when absent), blended dominant color, mean brightness."""
    keys = ["device_id", "local_month"]
    shares = frame.groupBy(*keys).agg(
        *[(F.count_if(F.col("color_mode") == m) / F.count(F.lit(1))).alias(f"{m}_share") for m in MODES],
        F.avg("brightness").alias("mean_brightness"))
    return (shares.join(blend_color(frame, keys, first_n=200), keys)
            .withColumnRenamed("local_month", "month"))


def color_timeline(df: DataFrame, date_col: str = "date") -> DataFrame:
    """date -> modal color (smallest on ties, black if none) and sample count (all rows)."""
    color = F.col("color_hex")
    counts = (df.withColumn(date_col, F.to_date("gw_timestamp"))
              .groupBy("device_id", date_col, "color_hex").agg(F.count(F.lit(1)).alias("n")))
    modal = F.min(F.when(color.isNotNull(), F.struct((-F.col("n")).alias("k"), color.alias("c"))))
    return (counts.groupBy("device_id", date_col).agg(F.sum("n").alias("sample_count"), modal.alias("m"))
            .select("device_id", date_col, "sample_count", F.coalesce("m.c", F.lit("#000000")).alias("dominant_color")))


def _ranked_colors(df: DataFrame, keys) -> DataFrame:
    """Colors of each group with count, % of all rows (NULL colors included) and rank; rows are counted once."""
    counts = df.groupBy(*keys, "color_hex").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col("color_hex").isNull(), F.desc("count"), F.asc("color_hex"))
    return (counts.withColumn("percentage", F.col("count") / F.sum("count").over(w) * 100.0)
            .withColumn("rank", F.row_number().over(order)).where(F.col("color_hex").isNotNull()))


def common_colors(df: DataFrame, n: int = 6) -> DataFrame:
    """Top ``n`` colors with count and % of all rows (NULL colors included in the base)."""
    return _ranked_colors(df, ["device_id"]).where(F.col("rank") <= n)


def unique_colors(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(F.count_distinct("color_hex").alias("unique_color_count"))


def day_colors(df: DataFrame, n: int = 4, day=None) -> DataFrame:
    """Top ``n`` colors of each (or one) day with % of that day's rows."""
    d = df.withColumn("date", F.to_date("gw_timestamp"))
    if day is not None:
        d = d.where(F.col("date") == F.lit(day).cast("date"))
    return _ranked_colors(d, ["device_id", "date"]).where(F.col("rank") <= n)


def color_statistics(df: DataFrame, n: int = 10) -> DataFrame:
    """Latest color (of the newest row), the top ``n`` colors as text, distinct count; rows are counted once."""
    color = F.col("color_hex")
    counts = df.groupBy("device_id", "color_hex").agg(F.count(F.lit(1)).alias("n"), F.max("gw_timestamp").alias("_t"))
    w = Window.partitionBy("device_id").orderBy(color.isNull(), F.desc("n"), F.asc("color_hex"))
    top = F.collect_list(F.when((F.col("rank") <= n) & color.isNotNull(), F.struct("rank", "color_hex")))
    return counts.withColumn("rank", F.row_number().over(w)).groupBy("device_id").agg(
        F.max(F.struct("_t", "color_hex")).getField("color_hex").alias("current"), F.count("color_hex").alias("unique_count"),
        F.when(F.count("color_hex") > 0, F.array_join(F.transform(F.array_sort(top), lambda s: s["color_hex"]), ",")).alias("most_common"))


def color_by_month(frame: DataFrame) -> DataFrame:
    return blend_color(frame, ["device_id", "local_month"])


def color_by_hour(frame: DataFrame) -> DataFrame:
    return blend_color(frame, ["device_id", "local_date", "hour"])


def color_diversity_trend(frame: DataFrame) -> DataFrame:
    """Distinct colors per month and the % change from the previous month."""
    m = frame.groupBy("device_id", F.col("local_month").alias("month")).agg(
        F.count_distinct("color_hex").alias("distinct_colors"))
    w = Window.partitionBy("device_id").orderBy("month")
    prev = F.lag("distinct_colors").over(w)
    return m.withColumn("pct_change", F.try_divide(F.col("distinct_colors") - prev, prev) * 100.0)


def color_regime_change(frame: DataFrame) -> DataFrame:
    """Days on which the sign of the daily mean warm-cool balance flips."""
    d = frame.groupBy("device_id", "local_date").agg(F.avg("warm_cool").alias("warm_cool"))
    w = Window.partitionBy("device_id").orderBy("local_date")
    prev = F.lag("warm_cool").over(w)
    return (d.withColumn("prev_warm_cool", prev)
            .where(F.signum("warm_cool") != F.signum("prev_warm_cool"))
            .withColumn("regime", F.when(F.col("warm_cool") > 0, "warm").when(F.col("warm_cool") < 0, "cool")
                        .otherwise("neutral")))


def warmest_hours(frame: DataFrame) -> DataFrame:
    """Warmest and coolest local hour by mean warm-cool balance (first hour wins ties)."""
    h = frame.groupBy("device_id", "hour").agg(F.avg("warm_cool").alias("wc"))
    return h.groupBy("device_id").agg(
        F.min(F.struct((-F.col("wc")).alias("k"), F.col("hour").alias("h"))).getField("h").alias("warmest_hour"),
        F.max(F.col("wc")).alias("warmest_wc"),
        F.min(F.struct(F.col("wc").alias("k"), F.col("hour").alias("h"))).getField("h").alias("coolest_hour"),
        F.min(F.col("wc")).alias("coolest_wc"))


def color_swatches(df: DataFrame) -> DataFrame:
    """Per distinct color: luma, contrast label, display name, count."""
    return (df.where(X.hex_valid("color_hex")).groupBy("device_id", "color_hex").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("luma", X.luma(X.hex_channel("color_hex", 0), X.hex_channel("color_hex", 1),
                                       X.hex_channel("color_hex", 2)))
            .withColumn("label_color", X.contrast_label("luma"))
            .withColumn("color_name", X.color_name("color_hex")))


def hex_from_raw(raw_color: DataFrame, sensor_max: float = 786.0) -> DataFrame:
    """Raw color captures -> ``#RRGGBB`` (scaled, clamped; a missing channel gives 00)."""
    return raw_color.select("device_id", "ts", "c", X.rgb_to_hex("r", "g", "b", sensor_max).alias("color_hex"))
