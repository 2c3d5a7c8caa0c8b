"""Sequence operators: gaps, reboots, lag correlation, robust z, anomaly episodes.

Raw-row windows never run over a whole device: ``time_gaps`` windows over
(device, hour bucket) and stitches bucket boundaries with a per-bucket
aggregate, so one very long series still spreads over many tasks.
Everything else runs on the hourly grain (devices x hours rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import pct, safe_corr, seconds_between, to_local
from roomtrace.operators.joins import join_null_safe, join_small


def time_gaps(df: DataFrame, ts: str = "gw_timestamp", bucket: str = "1 hour") -> DataFrame:
    """Add ``gw_gap_s`` (seconds since the previous reading) and ``mono_gap_s`` (uptime difference).

    Rows are ordered by (ts, timestamp_monotonic) within a device.  The window
    is partitioned by (device, bucket); the first row of each bucket takes its
    predecessor from the last row of the previous non-empty bucket, found by a
    small per-bucket ``max(struct)`` and a ``lag`` over bucket rows.
    """
    d = df.withColumn("_b", F.window(ts, bucket).start)
    w = Window.partitionBy("device_id", "_b").orderBy(ts, "timestamp_monotonic")
    # the last row of each bucket is found map-side: raw rows are shuffled and sorted once, for the window
    last = d.groupBy("device_id", "_b").agg(F.max(F.struct(F.col(ts).alias("t"), F.col("timestamp_monotonic").alias("m"))).alias("_last"))
    d = d.withColumns({"_pts": F.lag(ts).over(w), "_pmono": F.lag("timestamp_monotonic").over(w), "_first": F.row_number().over(w) == 1})
    prev = last.select("device_id", "_b", F.lag("_last").over(Window.partitionBy("device_id").orderBy("_b")).alias("_prev"))
    out = join_small(d, prev, ["device_id", "_b"], "left")
    pts = F.when(F.col("_first"), F.col("_prev.t")).otherwise(F.col("_pts"))
    pmono = F.when(F.col("_first"), F.col("_prev.m")).otherwise(F.col("_pmono"))
    return (out.withColumn("gw_gap_s", seconds_between(F.col(ts), pts))
            .withColumn("mono_gap_s", F.col("timestamp_monotonic") - pmono)
            .drop("_b", "_pts", "_pmono", "_first", "_prev"))


def gap_rows(gaps: DataFrame, min_gap_s: float = 3600, tz: str | None = None) -> DataFrame:
    g = gaps.where(F.col("gw_gap_s") > min_gap_s)
    return g.select("device_id", "gw_timestamp", "gw_gap_s", (F.col("gw_gap_s") / 3600.0).alias("gap_hours"))


def top_n(df: DataFrame, n: int, order, part=("device_id",)) -> DataFrame:
    """First ``n`` rows per group by ``order`` (Spark plans a partial WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_gaps(gaps: DataFrame, n: int = 8, min_gap_s: float = 3600) -> DataFrame:
    return top_n(gap_rows(gaps, min_gap_s), n, [F.desc("gw_gap_s"), F.asc("gw_timestamp")])


def device_reboots(gaps: DataFrame, n: int = 12) -> DataFrame:
    """Rows where uptime went backwards; the first ``n`` per device."""
    r = gaps.where(F.col("mono_gap_s") < 0).select("device_id", "gw_timestamp", "mono_gap_s")
    return top_n(r, n, [F.asc("gw_timestamp")])


RANGES = 64  # ranges of values that a rank is looked for in


def _counted_values(df: DataFrame, **values) -> DataFrame:
    """One row per (device, kind, value): rows, first and last time.  Counted map-side from one read of ``df``."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("value")) for k, v in values.items()])
    n = (df.select("device_id", "gw_timestamp", F.explode(cells).alias("_c")).select("device_id", "gw_timestamp", "_c.*")
         .groupBy("device_id", "kind", "value").agg(F.count("value").alias("n"), F.min("gw_timestamp").alias("_t0"), F.max("gw_timestamp").alias("_t1")))
    # all readers of the counts need the same columns, so that their exchange is planned once and reused
    return n.where(F.coalesce(F.col("_t0"), F.col("_t1")).isNotNull() | (F.col("n") >= 0))


def median_of_counts(counted: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Exact medians (mean of the two middle values) per (device, kind) of ``_counted_values``, without one task
    that sorts a device's values.

    Distributed selection: a mergeable quantile sketch of the distinct values cuts them into ranges of about
    equal size; the values of each range are counted exactly; running sums over the ranges (few rows) tell
    which ones hold the middle ranks, and only their values are ranked.  The sketch decides how evenly the
    ranges are cut, never the result.
    """
    key = ["device_id", "kind"]
    n = counted.where("n > 0")  # NULL values count none
    shares = [i / ranges for i in range(1, ranges)]
    cuts = n.groupBy(*key).agg(F.percentile_approx("value", shares, 100 * ranges).alias("cuts"))
    cut = join_null_safe(n, cuts, key).withColumn("_r", F.aggregate("cuts", F.lit(0), lambda s, c: s + (c < F.col("value")).cast("int")))
    cut = cut.select(*key, "_r", "value", "n", "_t0", "_t1")
    sums = cut.groupBy(*key, "_r").agg(F.sum("n").alias("_in"), F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"))
    w = Window.partitionBy(*key)
    sums = sums.withColumns({"_before": F.sum("_in").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"),
                             "_all": F.sum("_in").over(w)})
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    holds = sums.where(((F.col("_before") <= lower) & (lower < F.col("_before") + F.col("_in")))
                       | ((F.col("_before") <= upper) & (upper < F.col("_before") + F.col("_in"))))
    few = join_null_safe(cut.drop("_t0", "_t1"), holds.select(*key, "_r", "_before", "_all"), [*key, "_r"])
    here = Window.partitionBy(*key, "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_upto", F.col("_before") + F.sum("n").over(here))

    def at(rank):
        return F.max(F.when((F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto")), F.col("value")))

    return few.groupBy(*key).agg(((at(lower) + at(upper)) / 2).alias("median"))


def _medians(counted: DataFrame, **names) -> DataFrame:
    """Medians of some kinds as columns, a row per device."""
    of = median_of_counts(counted)
    return of.groupBy("device_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(name) for name, k in names.items()])


def cadence_summary(gaps: DataFrame) -> DataFrame:
    counted = _counted_values(gaps, gap=F.col("gw_gap_s"))
    whole = counted.groupBy("device_id").agg(F.min("_t0").alias("first_ts"), F.max("_t1").alias("last_ts"), (F.max("value") / 3600.0).alias("max_gap_h"))
    out = join_null_safe(whole, _medians(counted, median_gap_s="gap"), ["device_id"], "left")
    return out.select("device_id", "first_ts", "last_ts", "median_gap_s", "max_gap_h")


def kpis(gaps_loc: DataFrame) -> DataFrame:
    """Active dates of calendar days, median cadence, median temperature, outages > 1 h."""
    counted = _counted_values(gaps_loc, gap=F.col("gw_gap_s"), temp=F.col("temperature_sht"), date=F.unix_date(F.col("local_date").cast("date")))
    whole = counted.groupBy("device_id").agg(
        F.count_if((F.col("kind") == "date") & F.col("value").isNotNull()).alias("active_dates"),
        (F.floor(seconds_between(F.max("_t1"), F.min("_t0")) / 86400) + 1).cast("bigint").alias("total_span_days"),
        F.coalesce(F.sum(F.when((F.col("kind") == "gap") & (F.col("value") > 3600), F.col("n"))), F.lit(0).cast("bigint")).alias("outages_gt_1h"))
    out = join_null_safe(whole, _medians(counted, median_cadence_s="gap", median_temp="temp"), ["device_id"], "left")
    return out.select("device_id", "active_dates", "total_span_days", "median_cadence_s", "median_temp", "outages_gt_1h")


# ---------------------------------------------------------------------------
# Lagged correlation on the hourly grain
# ---------------------------------------------------------------------------

def join_lagged(hourly: DataFrame, x: str, y: str, lags, key: str = "hour_ts") -> DataFrame:
    """Pairs (x at h, y at h + k hours) for every k in ``lags``: an equi join on the shifted hour."""
    a = (hourly.select("device_id", F.col(key).alias("_h"), F.col(x).alias("x"))
         .withColumn("lag_hours", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
         .withColumn("_t", F.col("_h") + F.make_dt_interval(F.lit(0), F.col("lag_hours"))))
    b = hourly.select("device_id", F.col(key).alias("_t"), F.col(y).alias("y"))
    return a.join(b, ["device_id", "_t"], "left")


def lag_profile(hourly: DataFrame, x: str = "light", y: str = "temp", lags=range(-12, 13)) -> DataFrame:
    """corr(x[t], y[t + k]) per lag k (hours), pairwise complete."""
    return (join_lagged(hourly, x, y, lags).groupBy("device_id", "lag_hours")
            .agg(safe_corr("x", "y").alias("correlation")))


def best_lag(profile: DataFrame) -> DataFrame:
    """Largest correlation among lags >= 0; the smallest lag wins ties."""
    b = (profile.where((F.col("lag_hours") >= 0) & F.col("correlation").isNotNull())
         .groupBy("device_id")
         .agg(F.max(F.struct(F.col("correlation").alias("r"), (-F.col("lag_hours")).alias("k"))).alias("b")))
    return b.select("device_id", (-F.col("b.k")).alias("lag_hours"), F.col("b.r").alias("correlation"))


# ---------------------------------------------------------------------------
# Robust z, anomaly score, episodes
# ---------------------------------------------------------------------------

SCORE_COLS = ["temp", "humidity", "pressure", "light", "sound"]


def robust_z(hourly: DataFrame, cols=SCORE_COLS, k: float = 0.6745) -> DataFrame:
    """Add ``<c>_rz`` = k (x - median) / MAD per device; all 0 when MAD is 0 or NULL.

    Median and MAD are window percentiles over the device's hourly rows: the
    hourly grain of one device is bounded by its hours (8,760 a year), so one
    shuffle by device replaces two aggregate-and-join-back steps.
    """
    w = Window.partitionBy("device_id")
    j = hourly.withColumns({f"_{c}_med": pct(c, 0.5).over(w) for c in cols})
    j = j.withColumns({f"_{c}_mad": pct(F.abs(F.col(c) - F.col(f"_{c}_med")), 0.5).over(w) for c in cols})
    rz = {}
    for c in cols:
        m = F.col(f"_{c}_mad")
        rz[f"{c}_rz"] = F.when(m.isNull() | (m == 0), F.lit(0.0)).otherwise(k * (F.col(c) - F.col(f"_{c}_med")) / m)
    return j.withColumns(rz).drop(*[f"_{c}_med" for c in cols], *[f"_{c}_mad" for c in cols])


def anomaly_score(hourly: DataFrame, cols=SCORE_COLS, quantile: float = 0.995) -> DataFrame:
    """Sum of |robust z| (NULL counts 0); an hour is an event if its score >= the device's p99.5."""
    rz = robust_z(hourly, cols)
    score = sum((F.coalesce(F.abs(F.col(f"{c}_rz")), F.lit(0.0)) for c in cols), F.lit(0.0))
    s = rz.withColumn("anomaly_score", score)
    thr = pct("anomaly_score", quantile).over(Window.partitionBy("device_id"))
    return s.withColumn("threshold", thr).withColumn("is_event", F.col("anomaly_score") >= F.col("threshold"))


def episodes(scored: DataFrame, max_gap_hours: int = 1) -> DataFrame:
    """Gaps-and-islands over event hours: a run continues while the next event hour is <= max_gap_hours away.

    On the contiguous hourly grid ``max_gap_hours=1`` means consecutive event hours.
    """
    ev = scored.where(F.col("is_event"))
    w = Window.partitionBy("device_id").orderBy("hour_ts")
    gap = seconds_between(F.col("hour_ts"), F.lag("hour_ts").over(w))
    ev = ev.withColumn("_new", F.coalesce(gap > max_gap_hours * 3600, F.lit(True)).cast("int"))
    ev = ev.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (ev.groupBy("device_id", "episode").agg(
        F.min("hour_ts").alias("start"), F.max("hour_ts").alias("end"),
        F.max("anomaly_score").alias("score"), F.max("light").alias("peak_light"),
        F.max("sound").alias("peak_sound"), F.min("humidity").alias("min_humidity"),
        (F.max("temp") - F.min("temp")).alias("temp_span"), F.count(F.lit(1)).alias("event_hours"))
        .withColumn("duration_h", seconds_between("end", "start") / 3600.0 + 1.0))


def join_episode_weather(eps: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather rows with start <= hour <= end per episode: explode each episode into its hours
    (an equi join instead of a range join), then sum precipitation and max gust."""
    hours = eps.select("device_id", "episode",
                       F.explode(F.sequence("start", "end", F.expr("interval 1 hour"))).alias("hour_ts"))
    return (hours.join(weather.select("hour_ts", "precipitation", "wind_gusts_10m"), "hour_ts")
            .groupBy("device_id", "episode")
            .agg(F.sum("precipitation").alias("rain_sum"), F.max("wind_gusts_10m").alias("gust_max"),
                 F.count(F.lit(1)).alias("weather_hours")))


# Episode label rules (threshold, text), in output order.
EPISODE_RULES = [
    ("peak_light", ">=", 10000, "extreme brightness"),
    ("peak_sound", ">=", 400, "sound spike"),
    ("min_humidity", "<=", 18, "very dry air"),
    ("temp_span", ">=", 5, "fast temperature swing"),
    ("rain_sum", ">=", 5, "storm rain outside"),
    ("gust_max", ">=", 50, "high gusts outside"),
]
DEFAULT_LABEL = "mixed sensor anomaly"


def add_episode_weather(eps: DataFrame, weather: DataFrame) -> DataFrame:
    """``eps`` plus rain_sum, gust_max and weather_hours (NULL without weather rows), from one read
    of ``eps``: each episode is exploded into its hours carrying its columns, left-joined with the
    weather hours and aggregated back on the episode's columns.  (Joining ``eps`` with an aggregate
    derived from ``eps`` would compute the episodes, and everything before them, twice.)"""
    hours = eps.withColumn("_wh", F.explode(F.sequence("start", "end", F.expr("interval 1 hour"))))
    w = weather.select(F.col("hour_ts").alias("_wh"), F.col("precipitation").alias("_p"),
                       F.col("wind_gusts_10m").alias("_g"), F.lit(1).alias("_m"))
    n = F.count("_m")
    return (hours.join(w, "_wh", "left").groupBy(*eps.columns)
            .agg(F.sum("_p").alias("rain_sum"), F.max("_g").alias("gust_max"), F.when(n > 0, n).alias("weather_hours")))


def episode_labels(eps: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Join reasons with ', ' in rule order, else 'mixed sensor anomaly'."""
    if weather is not None:
        eps = add_episode_weather(eps, weather)
    else:
        eps = (eps.withColumn("rain_sum", F.lit(None).cast("double"))
               .withColumn("gust_max", F.lit(None).cast("double")))
    parts = []
    for col, op, thr, text in EPISODE_RULES:
        c = F.col(col)
        cond = c >= thr if op == ">=" else c <= thr
        parts.append(F.when(cond, F.lit(text)))
    lab = F.concat_ws(", ", *parts)
    return eps.withColumn("label", F.when(lab == "", DEFAULT_LABEL).otherwise(lab))


def top_episodes(labeled: DataFrame, n: int = 10) -> DataFrame:
    return top_n(labeled, n, [F.desc("score"), F.asc("start")])


def local_label(df: DataFrame, col: str, tz: str) -> DataFrame:
    return df.withColumn(f"{col}_local", to_local(col, tz))
