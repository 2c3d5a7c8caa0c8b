"""Period comparison: two ranges of one scan, compared with conditional aggregates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtrace.functions.exprs import seconds_between
from roomtrace.functions.timefn import _lit_ts
from roomtrace.operators.grain import long_form
from roomtrace.operators.series import top_n


def _in(p: dict, ts="gw_timestamp") -> F.Column:
    c = F.lit(True)
    if p.get("start") is not None:
        c = c & (F.col(ts) >= _lit_ts(p["start"]))
    if p.get("end") is not None:
        c = c & (F.col(ts) < _lit_ts(p["end"]))
    return c


def compare_periods(df: DataFrame, period1: dict, period2: dict, sensors=None) -> DataFrame:
    """Per device and sensor: mean/min/max/std/count of each period and their differences.

    Both periods come from one scan (the time filter on either range is
    pushed to the Parquet scan as an OR); no join.
    """
    lf = long_form(df.where(_in(period1) | _in(period2)), sensors)
    aggs = []
    for i, p in ((1, period1), (2, period2)):
        v = F.when(_in(p), F.col("value"))
        aggs += [F.avg(v).alias(f"p{i}_mean"), F.min(v).alias(f"p{i}_min"), F.max(v).alias(f"p{i}_max"),
                 F.stddev_samp(v).alias(f"p{i}_std"), F.count(v).alias(f"p{i}_count")]
    g = lf.groupBy("device_id", "sensor").agg(*aggs)
    return (g.withColumn("mean_diff", F.col("p1_mean") - F.col("p2_mean"))
            .withColumn("mean_diff_percent", F.try_divide(F.col("p1_mean") - F.col("p2_mean"), F.col("p2_mean")) * 100)
            .withColumn("min_diff", F.col("p1_min") - F.col("p2_min"))
            .withColumn("max_diff", F.col("p1_max") - F.col("p2_max"))
            .withColumn("std_diff", F.col("p1_std") - F.col("p2_std")))


def compare_series(df: DataFrame, sensor: str, period1: dict, period2: dict) -> DataFrame:
    """Rows of both periods for an overlay, from one scan: period label and seconds since that period's start."""
    spans = (("period1", period1), ("period2", period2))
    cells = F.array(*[F.when(_in(p), F.struct(F.lit(lab).alias("period"), seconds_between(F.col("gw_timestamp"), _lit_ts(p["start"])).alias("elapsed_s")))
                      for lab, p in spans])  # a row may lie in both
    rows = df.where((_in(period1) | _in(period2)) & F.col(sensor).isNotNull())
    rows = rows.select("device_id", "gw_timestamp", F.col(sensor).cast("double").alias("value"), F.explode(F.array_compact(cells)).alias("c"))
    return rows.select("device_id", "c.period", "gw_timestamp", "value", "c.elapsed_s")


def insight_period_change(cmp: DataFrame, n: int = 3) -> DataFrame:
    """Biggest relative changes between the periods (|mean %| descending)."""
    d = cmp.where(F.col("mean_diff_percent").isNotNull()).withColumn("abs_pct", F.abs("mean_diff_percent"))
    return top_n(d, n, [F.desc("abs_pct"), F.asc("sensor")])


def preset_ranges(as_of, preset: str = "week") -> tuple[dict, dict]:
    """This week/month vs the previous one, ending at ``as_of``."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    span = _dt.timedelta(days=7 if preset == "week" else 30)
    return ({"start": as_of - span, "end": as_of}, {"start": as_of - 2 * span, "end": as_of - span})


def compare_presets(df: DataFrame, as_of, preset: str = "week", flag_pct: float = 20.0, sensors=None) -> DataFrame:
    p1, p2 = preset_ranges(as_of, preset)
    return compare_periods(df, p1, p2, sensors).withColumn(
        "flagged", F.coalesce(F.abs("mean_diff_percent") > flag_pct, F.lit(False)))
