"""Insight rows: trend, weekday/weekend, latest anomaly, milestones, correlation, summaries.

Every generator returns rows with the same columns so they union into one
frame: device_id, category, priority, title, description, sensor, metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtrace.functions.exprs import EPOCH_NTZ, first_max, hour_float, iso_str, month_str, safe_corr, seconds_between, to_local
from roomtrace.operators.grain import long_form
from roomtrace.operators.joins import join_small
from roomtrace.schema import NUMERIC_SENSORS

# Display names of the sensors in insight texts.
SENSOR_NAMES = {
    "temperature_sht": "Temperature",
    "humidity": "Humidity",
    "pressure": "Pressure",
    "light": "Light",
    "sound_level": "Sound",
}
INSIGHT_COLUMNS = ["device_id", "category", "priority", "title", "description", "sensor", "metric"]
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}


def _name(col="sensor") -> F.Column:
    m = F.create_map(*[F.lit(x) for kv in SENSOR_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col(col)), F.col(col))


def num(x, digits: int = 1) -> F.Column:
    """Number as text with ``digits`` decimals: round(x * 10^d) / 10^d rendered by the shortest repr."""
    x = F.col(x) if isinstance(x, str) else x
    s = float(10 ** digits)
    return (F.round(x.cast("double") * s, 0) / s).cast("string")


def signed(x, digits: int = 1) -> F.Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.concat(F.when(x >= 0, "+").otherwise(""), num(x, digits))


def insight_row(df: DataFrame, category: str, priority, title, description, sensor, metric) -> DataFrame:
    return df.select("device_id", F.lit(category).alias("category"), priority.alias("priority"),
                     title.alias("title"), description.alias("description"), sensor.alias("sensor"),
                     metric.cast("double").alias("metric"))


def trend_slopes(df: DataFrame, sensors=("temperature_sht", "humidity", "pressure"), mode: str = "elapsed",
                 samples_per_day: int = 2880) -> DataFrame:
    """Per device and sensor: daily change by OLS.

    ``elapsed``: slope of value on days since the device's first reading (robust to
    uneven cadence).  ``sample_index``: slope per sample times ``samples_per_day``,
    with a global row index built from per-day counts (a cumulative sum over day
    rows) plus the row number within the day - no whole-series window.
    """
    lf = long_form(df, list(sensors))
    if mode == "elapsed":
        # days since a fixed epoch: the OLS slope does not change when x is shifted, so "days since
        # the device's first reading" needs no per-device minimum and join (one pass, one shuffle)
        x = seconds_between(F.col("gw_timestamp"), F.lit(EPOCH_NTZ).cast("timestamp_ntz")) / 86400.0
        g = (lf.withColumn("_x", x).groupBy("device_id", "sensor")
             .agg(F.regr_slope("value", "_x").alias("daily_change"), F.count("value").alias("n")))
    else:
        # rows are numbered before they are unpivoted, so equal times keep numbers of their own; a
        # window over each day and a running count of days keep the sort within device-days
        d = df.select("device_id", "gw_timestamp", *sensors).withColumn("_day", F.to_date("gw_timestamp"))
        per_day = d.groupBy("device_id", "_day").agg(F.count(F.lit(1)).alias("_c"))
        wd = Window.partitionBy("device_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        offs = per_day.withColumn("_off", F.coalesce(F.sum("_c").over(wd), F.lit(0)))
        rn = F.row_number().over(Window.partitionBy("device_id", "_day").orderBy("gw_timestamp", *sensors)) - 1
        idx = join_small(d.withColumn("_rn", rn), offs, ["device_id", "_day"]).withColumn("_x", F.col("_off") + F.col("_rn"))
        g = (long_form(idx, list(sensors), keep=("device_id", "_x")).groupBy("device_id", "sensor")
             .agg((F.regr_slope("value", "_x") * samples_per_day).alias("daily_change"), F.count("value").alias("n")))
    return g


def insight_trend(df: DataFrame, min_rows: int = 10, report: float = 0.5, high: float = 2.0, **kw) -> DataFrame:
    return trend_rows(trend_slopes(df, **kw), min_rows, report, high)


def trend_rows(slopes: DataFrame, min_rows: int = 10, report: float = 0.5, high: float = 2.0) -> DataFrame:
    """Insight rows of slopes (``device_id, sensor, daily_change, n``)."""
    s = slopes.where((F.col("n") >= min_rows) & (F.abs("daily_change") > report))
    direction = F.when(F.col("daily_change") > 0, "increasing").otherwise("decreasing")
    return insight_row(s, "trend", F.when(F.abs("daily_change") > high, "high").otherwise("medium"),
                 F.format_string("%s is %s", _name(), direction),
                 F.format_string("%s keeps %s: %s a day by linear fit", _name(), direction, signed("daily_change")),
                 F.col("sensor"), F.col("daily_change"))


def insight_weekend(df: DataFrame, sensors=("temperature_sht", "light", "sound_level"), min_pct: float = 10.0,
                    ts: str = "gw_timestamp") -> DataFrame:
    """Weekend vs weekday mean; reported when the difference exceeds 10 % of the weekday mean."""
    lf = long_form(df, list(sensors)).withColumn("_we", F.weekday(ts) >= 5)
    g = lf.groupBy("device_id", "sensor").agg(F.avg(F.when(~F.col("_we"), F.col("value"))).alias("weekday_mean"),
                                              F.avg(F.when(F.col("_we"), F.col("value"))).alias("weekend_mean"))
    return weekend_rows(g, min_pct)


def weekend_rows(means: DataFrame, min_pct: float = 10.0) -> DataFrame:
    """Insight rows of means (``device_id, sensor, weekday_mean, weekend_mean``)."""
    g = (means.withColumn("diff", F.col("weekend_mean") - F.col("weekday_mean"))
         .withColumn("pct", F.abs(F.try_divide(F.col("diff"), F.col("weekday_mean")) * 100))
         .where(F.col("pct") > min_pct))
    higher = F.when(F.col("diff") > 0, "weekends").otherwise("weekdays")
    return insight_row(g, "pattern", F.lit("medium"), F.format_string("%s stand out", F.initcap(higher)),
                 F.format_string("Mean %s is %s above the rest of the week on %s", _name(), num(F.abs("diff")), higher),
                 F.col("sensor"), F.col("diff"))


def insight_anomaly(anoms: DataFrame) -> DataFrame:
    """The most recent z-anomaly per device (sensor order breaks ties)."""
    order = F.create_map(*[x for i, s in enumerate(SENSOR_NAMES) for x in (F.lit(s), F.lit(i))])
    latest = anoms.groupBy("device_id").agg(F.max(F.struct(
        F.col("gw_timestamp").alias("t"), (-F.element_at(order, F.col("sensor"))).alias("o"),
        F.col("sensor").alias("sensor"), F.col("value").alias("value"), F.col("z_score").alias("z"),
        F.col("severity").alias("severity"))).alias("a"))
    a = latest.select("device_id", "a.*")
    return insight_row(a, "anomaly", F.lit("high"), F.format_string("Outlying %s", _name()),
                 F.format_string("%s outlier at %s: value %s, z-score magnitude %s", F.col("severity"),
                                 iso_str("t", micros=False, sep="T"), num("value", 2), num(F.abs("z"))),
                 F.col("sensor"), F.col("z"))


def insight_milestone(df: DataFrame, as_of=None, rows: int = 500_000, days: int = 180) -> DataFrame:
    """Row-count and monitoring-duration milestones (``as_of`` defaults to the newest reading)."""
    g = df.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.min("gw_timestamp").alias("t0"),
                                    F.max("gw_timestamp").alias("t1"))
    end = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.col("t1")
    return milestone_rows(g.withColumn("days", F.floor(seconds_between(end, F.col("t0")) / 86400)), rows, days)


def milestone_rows(g: DataFrame, rows: int = 500_000, days: int = 180) -> DataFrame:
    """Insight rows of ``device_id, n, days``."""
    a = insight_row(g.where(F.col("n") > rows), "milestone", F.lit("low"), F.lit("Row count passed its mark"),
              F.format_string("%d readings are stored", F.col("n")), F.lit(None).cast("string"),
              F.col("n"))
    b = insight_row(g.where(F.col("days") >= days), "milestone", F.lit("low"), F.lit("Monitoring time passed its mark"),
              F.format_string("First reading lies %d days back", F.col("days").cast("int")),
              F.lit(None).cast("string"), F.col("days"))
    return a.unionByName(b)


def insight_correlation(findings: DataFrame, min_abs: float = 0.4) -> DataFrame:
    f = findings.where(F.col("abs_r") >= min_abs)
    return insight_row(f, "correlation", F.lit("medium"),
                 F.format_string("%s and %s move together", _name("x"), _name("y")),
                 F.format_string("%s %s correlation between %s and %s (r = %s)", F.col("strength"),
                                 F.col("direction"), _name("x"), _name("y"), num("r", 2)),
                 F.concat_ws("|", "x", "y"), F.col("r"))


def insight_day_summary(df: DataFrame, stats: DataFrame, tz: str = "America/Chicago") -> DataFrame:
    """Temperature range, most stable sensor (lowest CV of temp/humidity/pressure), time of the light peak."""
    t = stats.where(F.col("sensor") == "temperature_sht").select(
        "device_id", (F.col("max") - F.col("min")).alias("temp_range"))
    cv = (stats.where(F.col("sensor").isin("temperature_sht", "humidity", "pressure") & (F.col("mean") > 0))
          .groupBy("device_id").agg(F.min(F.struct((F.col("std_dev") / F.col("mean") * 100).alias("cv"),
                                                   F.col("sensor").alias("s"))).alias("b")))
    peak = df.groupBy("device_id").agg(first_max("light", "gw_timestamp").alias("pk"))
    j = t.join(cv, "device_id", "left").join(peak, "device_id", "left")
    return j.select("device_id", "temp_range", F.col("b.s").alias("most_stable"), F.col("b.cv").alias("most_stable_cv"),
                    F.col("pk.o").alias("light_peak_ts"), hour_float(to_local("pk.o", tz)).alias("light_peak_local_hour"))


def insight_vs_last_period(df: DataFrame, tz: str = "America/Chicago") -> DataFrame:
    """Each month's sensor means against the previous month ("15 % lower than last month")."""
    lf = long_form(df).withColumn("month", month_str(to_local("gw_timestamp", tz)))
    m = lf.groupBy("device_id", "sensor", "month").agg(F.avg("value").alias("mean"))
    prev = F.lag("mean").over(Window.partitionBy("device_id", "sensor").orderBy("month"))
    m = m.withColumn("prev_mean", prev).withColumn("pct", F.try_divide(F.col("mean") - F.col("prev_mean"),
                                                                        F.col("prev_mean")) * 100)
    m = m.where(F.col("pct").isNotNull())
    return insight_row(m, "comparison", F.when(F.abs("pct") > 20, "medium").otherwise("low"),
                 F.format_string("%s in %s vs the month before", _name(), F.col("month")),
                 F.format_string("%s was %s%% %s than last month", _name(), num(F.abs("pct"), 0),
                                 F.when(F.col("pct") >= 0, "higher").otherwise("lower")),
                 F.col("sensor"), F.col("pct"))


def insight_arrival(loc: DataFrame) -> DataFrame:
    """Typical arrival: on weekdays, the local hour with the largest hour-on-hour rise of mean sound;
    the most frequent such hour (earliest on ties)."""
    wk = loc.where(F.weekday("local_ts") < 5)
    h = wk.groupBy("device_id", "local_date", "hour").agg(F.avg("sound_level").alias("s"))
    rise = F.col("s") - F.lag("s").over(Window.partitionBy("device_id", "local_date").orderBy("hour"))
    h = h.withColumn("rise", rise).where(F.col("rise").isNotNull())
    day = h.groupBy("device_id", "local_date").agg(first_max("rise", "hour").alias("b"))
    counts = day.groupBy("device_id", F.col("b.o").alias("hour")).agg(F.count(F.lit(1)).alias("days"))
    best = counts.groupBy("device_id").agg(F.min(F.struct((-F.col("days")).alias("k"), F.col("hour").alias("h")))
                                           .alias("m"))
    b = best.select("device_id", F.col("m.h").alias("hour"), (-F.col("m.k")).alias("days"))
    return insight_row(b, "pattern", F.lit("low"), F.lit("Typical arrival time"),
                 F.format_string("Sound usually jumps around %02d:00 on weekdays (%d days)", F.col("hour"),
                                 F.col("days")), F.lit("sound_level"), F.col("hour"))


def insight_quiet_week(df: DataFrame, tz: str = "America/Chicago", pct: float = 10.0) -> DataFrame:
    """Weeks whose mean sound is more than ``pct`` % below the device's overall mean."""
    lt = to_local("gw_timestamp", tz)
    s = df.where(F.col("sound_level").isNotNull()).withColumn("week", F.date_sub(F.to_date(lt), F.weekday(lt)))
    wk = s.groupBy("device_id", "week").agg(F.avg("sound_level").alias("m"), F.count(F.lit(1)).alias("n"))
    tot = s.groupBy("device_id").agg(F.avg("sound_level").alias("overall"))
    j = wk.join(tot, "device_id").withColumn("pct", (F.col("m") - F.col("overall")) / F.col("overall") * 100)
    j = j.where(F.col("pct") < -pct)
    return insight_row(j, "pattern", F.lit("low"), F.lit("Quieter week"),
                 F.format_string("The week of %s was %s%% quieter than usual", F.col("week").cast("string"),
                                 num(F.abs("pct"), 0)), F.lit("sound_level"), F.col("pct"))


def insights(*parts: DataFrame) -> DataFrame:
    """Union of insight rows with a priority rank (high, medium, low) for ordering."""
    out = None
    for p in parts:
        out = p.select(*INSIGHT_COLUMNS) if out is None else out.unionByName(p.select(*INSIGHT_COLUMNS))
    rank = F.create_map(*[x for k, v in PRIORITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("priority_rank", F.element_at(rank, F.col("priority")))


def summary_cells(df: DataFrame, as_of=None, trend=("temperature_sht", "humidity", "pressure"),
                  weekend=("temperature_sht", "light", "sound_level"), ts: str = "gw_timestamp") -> DataFrame:
    """Everything that the insight generators need of the raw rows, from one aggregate a device: ``kind`` is
    ``stat`` (mean ``v``, deviation ``w``, count ``n`` of a sensor), ``trend`` (slope a day), ``weekend`` (weekday and
    weekend mean), ``corr`` (Pearson r of ``x`` and ``y``) or ``rows`` (row count, days monitored).

    The cells are one exploded array, so that frames which read different kinds share one plan of the
    aggregate and its exchange is reused: the raw rows are read once however many generators there are.
    """
    day = seconds_between(F.col(ts), F.lit(EPOCH_NTZ).cast("timestamp_ntz")) / 86400.0
    names = list(NUMERIC_SENSORS)
    v = {s: F.col(s).cast("double") for s in names}
    off = F.weekday(ts) >= 5
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    g = df.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1"),
        *[f(v[s]).alias(f"{k}_{s}") for s in names for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))],
        *[F.regr_slope(v[s], day).alias(f"slope_{s}") for s in trend],
        *[F.avg(F.when(~off, v[s])).alias(f"week_{s}") for s in weekend], *[F.avg(F.when(off, v[s])).alias(f"end_{s}") for s in weekend],
        *[safe_corr(names[i], names[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    end = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.col("t1")

    def cell(kind: str, sensor=None, x=None, y=None, i=0, j=0, v=None, w=None, n=None):
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("kind"), F.lit(sensor).cast("string").alias("sensor"), F.lit(x).cast("string").alias("x"),
                        F.lit(y).cast("string").alias("y"), F.lit(i).alias("i"), F.lit(j).alias("j"), (none if v is None else F.col(v)).cast("double").alias("v"),
                        (none if w is None else F.col(w)).cast("double").alias("w"), (none if n is None else F.col(n)).cast("long").alias("n"))

    g = g.withColumn("days", F.floor(seconds_between(end, F.col("t0")) / 86400))
    cells = [cell("rows", v="days", n="n")]
    cells += [cell("stat", s, v=f"mean_{s}", w=f"std_{s}", n=f"n_{s}") for s in names]
    cells += [cell("trend", s, v=f"slope_{s}", n=f"n_{s}") for s in trend]
    cells += [cell("weekend", s, v=f"week_{s}", w=f"end_{s}") for s in weekend]
    cells += [cell("corr", x=names[i], y=names[j], i=i, j=j, v=f"r_{i}_{j}") for i, j in pairs]
    return g.select("device_id", F.explode(F.array(*cells)).alias("c")).select("device_id", "c.*")


def all_insights(df: DataFrame, as_of=None) -> DataFrame:
    """Trend, weekend, latest anomaly, milestones and correlations of cleaned readings, in two reads of them: one
    for the summary, one for the anomalies it tells."""
    from roomtrace.operators.anomalies import anomalies_z
    from roomtrace.operators.stats import correlation_findings

    cells = summary_cells(df, as_of)

    def of(kind: str, **cols) -> DataFrame:
        return cells.where(F.col("kind") == kind).select("device_id", *[F.col(c).alias(k) for k, c in cols.items()])

    stats = of("stat", sensor="sensor", mean="v", std="w", n="n")
    return insights(
        trend_rows(of("trend", sensor="sensor", daily_change="v", n="n")),
        weekend_rows(of("weekend", sensor="sensor", weekday_mean="v", weekend_mean="w")),
        insight_anomaly(anomalies_z(df, stats=stats)),
        milestone_rows(of("rows", n="n", days="v")),
        insight_correlation(correlation_findings(of("corr", x="x", y="y", i="i", j="j", r="v"))))


def hour_label(h) -> F.Column:
    """``13.5`` -> ``1:30 PM``; whole hours -> ``1 PM``."""
    h = F.col(h) if isinstance(h, str) else h
    hr = F.pmod(F.floor(h), 24)
    mi = F.pmod(F.round((h - F.floor(h)) * 60), 60).cast("int")
    h12 = F.when(F.pmod(hr, 12) == 0, 12).otherwise(F.pmod(hr, 12))
    suf = F.when(hr < 12, "AM").otherwise("PM")
    return F.when(h.isNull(), "n/a").when(mi == 0, F.format_string("%d %s", h12.cast("int"), suf)).otherwise(
        F.format_string("%d:%02d %s", h12.cast("int"), mi, suf))


# ---------------------------------------------------------------------------
# Section sentences of the analysis payload
# ---------------------------------------------------------------------------

# The section sentences; {name} marks a numeric slot filled per device from the data.
SECTION_TEXTS = {
    "seasonal_light": "Peak light shifts by {shift} hours between months: earliest {earliest}, latest {latest}.",
    "activity_profile": "Midday medians of active days: light {light}, sound {sound}.",
    "heat_lag": "Light leads temperature most clearly at a lag of {lag} hours (r={r}).",
    "color_modes": "Each month is described by its shares of dark, warm, cool and neutral readings.",
    "discomfort": "The 95th percentile of discomfort is highest near {hour}.",
    "anomalies": "Episodes are ranked by the robust z-score of their strongest sensor.",
    "routine": "Daily activity classes are counted month by month.",
    "pressure": "Daily pressure correlates with temperature at r={temp_r} and with sound at r={sound_r}.",
    "weather": "Indoor and outdoor temperature correlate at r={temp_r}, most at a lag of {lag} hours; the pressures differ by {gap} hPa.",
}


def fmt_num(x, digits: int = 1) -> F.Column:
    """Thousands separators, ``digits`` decimals (half-even), 'n/a' for NULL/NaN."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("n/a")).otherwise(F.format_number(x, digits))


def hour_label_even(h) -> F.Column:
    """Like ``hour_label`` with the minute rounded half-even (Python ``round``)."""
    h = (F.col(h) if isinstance(h, str) else h).cast("double")
    hr = F.pmod(F.floor(h), 24)
    mi = F.pmod(F.bround((h - F.floor(h)) * 60, 0), 60).cast("int")
    h12 = F.when(F.pmod(hr, 12) == 0, 12).otherwise(F.pmod(hr, 12))
    suf = F.when(hr < 12, "AM").otherwise("PM")
    return F.when(h.isNull() | F.isnan(h), "n/a").when(mi == 0, F.format_string("%d %s", h12.cast("int"), suf)) \
        .otherwise(F.format_string("%d:%02d %s", h12.cast("int"), mi, suf))


def _fill(template: str, **slots: F.Column) -> F.Column:
    """Template with {name} slots -> concat of literal pieces and slot columns."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(slots[m.group(1)], F.lit("n/a")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def insight_sections(devices: DataFrame, shift: DataFrame, profile: DataFrame, best: DataFrame,
                     discomfort_hour: DataFrame, pressure_r: DataFrame, weather_cmp: DataFrame | None = None,
                     outdoor_best: DataFrame | None = None) -> DataFrame:
    """One row per device and section with the filled sentence (only the numeric slots vary)."""
    prof = profile.groupBy("device_id").agg(
        F.max(F.coalesce("active_light", F.lit(0.0))).alias("_al"), F.max(F.coalesce("active_sound", F.lit(0.0)))
        .alias("_as"))
    dh = discomfort_hour.groupBy("device_id").agg(first_max("discomfort_p95", "hour").alias("_dh"))
    pr = pressure_r.groupBy("device_id").agg(F.max(F.when(F.col("sensor") == "temp", F.col("r"))).alias("_pt"),
                                             F.max(F.when(F.col("sensor") == "sound", F.col("r"))).alias("_ps"))
    j = (devices.join(shift, "device_id", "left").join(prof, "device_id", "left")
         .join(best.select("device_id", F.col("lag_hours").alias("_bl"), F.col("correlation").alias("_br")),
               "device_id", "left")
         .join(dh, "device_id", "left").join(pr, "device_id", "left"))
    if weather_cmp is not None:
        j = j.join(weather_cmp.select("device_id", F.col("indoor_outdoor_temp_corr").alias("_wt"),
                                      F.col("pressure_gap_median_hpa").alias("_wg")), "device_id", "left")
    else:
        j = j.withColumns({"_wt": F.lit(None).cast("double"), "_wg": F.lit(None).cast("double")})
    if outdoor_best is not None:
        j = j.join(outdoor_best.select("device_id", F.col("lag_hours").alias("_ol")), "device_id", "left")
    else:
        j = j.withColumn("_ol", F.lit(None).cast("int"))
    t = SECTION_TEXTS
    texts = {
        "seasonal_light": _fill(t["seasonal_light"], shift=fmt_num("peak_shift_hours", 1),
                                earliest=hour_label_even("earliest_peak_hour"),
                                latest=hour_label_even("latest_peak_hour")),
        "activity_profile": _fill(t["activity_profile"], light=fmt_num("_al", 0), sound=fmt_num("_as", 0)),
        "heat_lag": _fill(t["heat_lag"], lag=F.col("_bl").cast("string"), r=fmt_num("_br", 2)),
        "color_modes": F.lit(t["color_modes"]),
        "discomfort": _fill(t["discomfort"], hour=hour_label_even(F.col("_dh.o"))),
        "anomalies": F.lit(t["anomalies"]),
        "routine": F.lit(t["routine"]),
        "pressure": _fill(t["pressure"], temp_r=fmt_num("_pt", 2), sound_r=fmt_num("_ps", 2)),
        "weather": _fill(t["weather"], temp_r=fmt_num("_wt", 2), lag=F.col("_ol").cast("string"),
                         gap=fmt_num("_wg", 1)),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("section"), v.alias("text"))
                     for i, (k, v) in enumerate(texts.items())])
    return j.select("device_id", F.explode(rows).alias("s")).select("device_id", "s.*")
