"""Column expressions: conversions, colors, comfort scores, safe statistics.

All of these are built-in Spark expressions (whole-stage codegen); no
Python UDF is involved anywhere.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from roomtrace.schema import DEFAULT_TZ


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Units and rounding
# ---------------------------------------------------------------------------

def celsius_to_fahrenheit(c, digits: int | None = 2) -> Column:
    """deg C -> deg F; the live path rounds half-even to 2 digits, weather does not round."""
    f = _c(c) * 9 / 5 + 32
    return F.bround(f, digits) if digits is not None else f


def nan_to_null(x) -> Column:
    """Map NaN to NULL (Spark keeps NaN from text, pandas treats it as missing)."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip_lower(x, lo: float) -> Column:
    """pandas ``clip(lower=lo)``: NULL stays NULL (``greatest`` would skip it)."""
    c = _c(x)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(c.cast("double"), F.lit(float(lo))))


# ---------------------------------------------------------------------------
# Time
# ---------------------------------------------------------------------------

def to_local(ts, tz: str = DEFAULT_TZ) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) -> local wall time in ``tz`` (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def to_utc(ts, tz: str = DEFAULT_TZ) -> Column:
    """Local wall time in ``tz`` -> UTC wall time (both TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts))


def hour_float(ts) -> Column:
    """``hour + minute/60`` (seconds ignored), the reference's local hour."""
    c = _c(ts)
    return F.hour(c) + F.minute(c) / 60.0


EPOCH_NTZ = "1970-01-01 00:00:00"


def _interval_seconds(iv: Column) -> Column:
    # NTZ - NTZ is a day-time interval computed on wall-clock micros; unlike
    # timestamp_diff/date_trunc it never consults the session time zone.
    return iv.cast("interval second").cast("decimal(24,6)")


def seconds_between(a, b) -> Column:
    """(a - b) in seconds as DOUBLE for TIMESTAMP_NTZ columns, exact and session-zone independent."""
    return _interval_seconds(_c(a) - _c(b)).cast("double")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of an NTZ wall time (session-zone independent)."""
    return (_interval_seconds(_c(ts) - F.lit(EPOCH_NTZ).cast("timestamp_ntz")) * 1000000).cast("bigint")


def floor_to(ts, seconds: int) -> Column:
    """Start of the ``seconds``-long bucket (aligned to the epoch), staying TIMESTAMP_NTZ.

    Pure interval arithmetic: usable several times in one projection (unlike
    ``window``) and independent of the session zone (unlike ``date_trunc``).
    """
    n = F.floor(epoch_micros(ts) / F.lit(seconds * 1000000))
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                       (n * seconds).cast("decimal(18,6)"))


def instant_from_utc_wall(ts) -> Column:
    """UTC wall time (NTZ) -> TIMESTAMP instant (needed for watermarks), without the session zone."""
    return F.timestamp_micros(epoch_micros(ts))


def utc_wall_from_instant(t) -> Column:
    """TIMESTAMP instant -> its UTC wall time as NTZ, without the session zone."""
    secs = (F.unix_micros(_c(t)) / F.lit(1000000)).cast("decimal(24,6)")
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def hour_floor(ts) -> Column:
    """Start of the hour, staying TIMESTAMP_NTZ."""
    return floor_to(ts, 3600)


def month_str(ts) -> Column:
    """``YYYY-MM`` of a wall time (``date_format`` would go through the session zone for NTZ)."""
    c = _c(ts)
    return F.format_string("%04d-%02d", F.year(c), F.month(c))


def iso_str(ts, micros: bool = True, sep: str = " ") -> Column:
    """Render an NTZ wall time as ISO text (session-zone independent)."""
    c = _c(ts)
    # the cast's text leaves out the last zeros of the fraction; no per-row java Formatter for years of four digits
    text = c.cast("string")
    plain = F.substring(text, 1, 19)
    if micros:
        plain = F.rpad(F.when(F.length(text) == 19, F.concat(text, F.lit("."))).otherwise(text), 26, "0")
    if sep != " ":
        plain = F.concat(F.substring(plain, 1, 10), F.lit(sep), F.substring(plain, 12, 15))
    base = F.format_string(f"%04d-%02d-%02d{sep}%02d:%02d:%02d", F.year(c), F.month(c), F.dayofmonth(c),
                           F.hour(c), F.minute(c), F.second(c))
    if micros:
        base = F.concat(base, F.format_string(".%06d", F.pmod(epoch_micros(c), F.lit(1000000))))
    return F.when(F.year(c).between(0, 9999), plain).when(c.isNotNull(), base)


# ---------------------------------------------------------------------------
# Colors
# ---------------------------------------------------------------------------

HEX_PATTERN = "^#[0-9A-Fa-f]{6}$"


def hex_valid(x) -> Column:
    c = _c(x)
    return c.isNotNull() & c.rlike(HEX_PATTERN)


def hex_channel(x, i: int) -> Column:
    """Channel ``i`` (0=r, 1=g, 2=b) of a ``#RRGGBB`` string, NULL when malformed."""
    c = _c(x)
    return F.when(hex_valid(c), F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int"))


def parse_hex(x) -> Column:
    """``#RRGGBB`` -> struct(r, g, b) or NULL."""
    c = _c(x)
    return F.when(hex_valid(c), F.struct(hex_channel(c, 0).alias("r"), hex_channel(c, 1).alias("g"),
                                         hex_channel(c, 2).alias("b")))


def brightness(r, g, b) -> Column:
    return (_c(r) + _c(g) + _c(b)) / 3.0


def warm_cool(r, b) -> Column:
    return _c(r) - _c(b)


def color_mode(bright, delta) -> Column:
    """First match wins: dark, warm, cool, else neutral."""
    return (F.when(_c(bright) < 20, "dark").when(_c(delta) > 20, "warm")
            .when(_c(delta) < -20, "cool").otherwise("neutral"))


def luma(r, g, b) -> Column:
    return (299 * _c(r) + 587 * _c(g) + 114 * _c(b)) / 1000.0


def contrast_label(lum) -> Column:
    return F.when(_c(lum) > 125, "black").otherwise("white")


# Color names shown for well-known swatches.
COLOR_NAMES = {
    "#FFFFFF": "Bright White",
    "#FFD4A3": "Warm White",
    "#FF8C42": "Orange Glow",
    "#2A3B4C": "Cool Blue",
    "#87CEEB": "Sky Blue",
    "#FFA07A": "Light Salmon",
    "#000000": "Dark/Off",
}


def color_name(x) -> Column:
    """Upper-cased lookup in ``COLOR_NAMES`` (a literal map, no join), else 'Custom Color'."""
    m = F.create_map(*[F.lit(v) for kv in COLOR_NAMES.items() for v in kv])
    return F.coalesce(F.element_at(m, F.upper(_c(x))), F.lit("Custom Color"))


def scale_clamp(v, sensor_max: float = 786.0, target_max: int = 255) -> Column:
    """``clamp(int(v / sensor_max * target_max), 0, target_max)``; a missing value gives 0."""
    scaled = (_c(v) / F.lit(sensor_max) * F.lit(target_max)).try_cast("int")
    return F.coalesce(F.least(F.greatest(scaled, F.lit(0)), F.lit(target_max)), F.lit(0))


def rgb_to_hex(r, g, b, sensor_max: float = 786.0) -> Column:
    return F.format_string("#%02X%02X%02X", scale_clamp(r, sensor_max), scale_clamp(g, sensor_max),
                           scale_clamp(b, sensor_max))


def sound_rms(samples, center: int = 32768) -> Column:
    """round(sqrt(mean((s - center)^2))) over an array of unsigned 16-bit samples.

    Half-even rounding like Python's ``round``; the mean divides by the array length.
    """
    s = _c(samples)
    sumsq = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x - center).cast("double") * (x - center))
    return F.when(F.size(s) > 0, F.bround(F.sqrt(sumsq / F.size(s)), 0).cast("bigint"))


# ---------------------------------------------------------------------------
# Comfort
# ---------------------------------------------------------------------------

def discomfort(temp, hum, sound) -> Column:
    """0.5*max(t-88,0) + max(22-h,0) + 0.03*max(s-120,0); NULL if any input is NULL."""
    t, h, s = _c(temp), _c(hum), _c(sound)
    return (clip_lower(t - 88.0, 0) * 0.5 + clip_lower(22.0 - h, 0) * 1.0
            + clip_lower(s.cast("double") - 120.0, 0) * 0.03)


# Ideal ranges, and how far the two wider bands reach below and above them.
COMFORT_IDEAL = {"temperature": (68, 74), "humidity": (40, 50), "light": (500, 2000), "sound": (0, 100)}
COMFORT_WIDER = {"temperature": ((3, 3), (8, 6)), "humidity": ((5, 5), (10, 10)), "light": ((300, 1000),), "sound": ((0, 100), (0, 300))}


def _banded(v: Column, ideal, wider) -> Column:
    """100 within the ideal range, 80 and 60 within the wider ones (unfinished ``when``)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in ideal)
    out = F.when(v.between(lo, hi), 100.0)
    for score, (below, above) in zip((80.0, 60.0), wider):
        out = out.when(v.between(lo - below, hi + above), score)
    return out


def _temp_score(t: Column, ideal=COMFORT_IDEAL["temperature"]) -> Column:
    middle = (ideal[0] + ideal[1]) / 2
    return _banded(t, ideal, COMFORT_WIDER["temperature"]).otherwise(F.greatest(F.lit(0.0), 100 - F.abs(t - middle) * 5))


def _humidity_score(h: Column, ideal=COMFORT_IDEAL["humidity"]) -> Column:
    middle = (ideal[0] + ideal[1]) / 2
    return _banded(h, ideal, COMFORT_WIDER["humidity"]).otherwise(F.greatest(F.lit(0.0), 100 - F.abs(h - middle) * 3))


def _light_score(lt: Column, ideal=COMFORT_IDEAL["light"]) -> Column:
    return _banded(lt, ideal, COMFORT_WIDER["light"]).otherwise(60.0)


def _sound_score(s: Column, ideal=COMFORT_IDEAL["sound"]) -> Column:
    most = ideal[1]
    return (F.when(s < most, 100.0).when(s < most + 100, 80.0).when(s < most + 300, 60.0)
            .otherwise(F.greatest(F.lit(0.0), 100 - (s - (most + 300)) / 5)))


# Sub-score weights and rating cut-offs.
COMFORT_WEIGHTS = {"temperature": 0.4, "humidity": 0.3, "light": 0.15, "sound": 0.15}
COMFORT_RATINGS = [(90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor")]


def comfort_scores(temp, hum, light, sound, weights: dict | None = None, ideal: dict | None = None) -> dict[str, Column]:
    """The four sub-scores, overall (0-100, 1 digit) and rating; NULL input gives NULL.

    ``weights`` and ``ideal`` (``temperature``, ``humidity``, ``light``, ``sound`` -> lowest and highest ideal
    value; of sound the highest counts) replace the defaults; ideal values may be columns, e.g. of a table of
    profiles per device.  The wider bands keep their distance from the ideal range.
    """
    w = dict(COMFORT_WEIGHTS, **(weights or {}))
    r = dict(COMFORT_IDEAL, **(ideal or {}))
    t, h, lt, s = _c(temp), _c(hum), _c(light).cast("double"), _c(sound).cast("double")
    ts, hs, ls, ss = _temp_score(t, r["temperature"]), _humidity_score(h, r["humidity"]), _light_score(lt, r["light"]), _sound_score(s, r["sound"])
    any_null = t.isNull() | h.isNull() | lt.isNull() | s.isNull()
    raw = ts * w["temperature"] + hs * w["humidity"] + ls * w["light"] + ss * w["sound"]
    rating = F.when(raw >= COMFORT_RATINGS[0][0], COMFORT_RATINGS[0][1])
    for cut, label in COMFORT_RATINGS[1:]:
        rating = rating.when(raw >= cut, label)
    rating = rating.otherwise("Very Poor")

    def guard(x):
        return F.when(~any_null, x)

    return {
        "temperature_score": F.when(t.isNotNull(), F.bround(ts, 1)),
        "humidity_score": F.when(h.isNotNull(), F.bround(hs, 1)),
        "light_score": F.when(lt.isNotNull(), F.bround(ls, 1)),
        "sound_score": F.when(s.isNotNull(), F.bround(ss, 1)),
        "comfort_index": guard(F.bround(raw, 1)),
        "rating": guard(rating),
    }


# Rothfusz heat-index coefficients.
HEAT_INDEX_COEF = [-42.379, 2.04901523, 10.14333127, -0.22475541, -6.83783e-3, -5.481717e-2,
                   1.22874e-3, 8.5282e-4, -1.99e-6]


def heat_index(temp_f, rh) -> Column:
    """T below 80 deg F is returned unchanged; otherwise the 9-term regression, 1 digit."""
    t, r = _c(temp_f), _c(rh)
    c = HEAT_INDEX_COEF
    hi = (c[0] + c[1] * t + c[2] * r + c[3] * t * r + c[4] * t * t + c[5] * r * r
          + c[6] * t * t * r + c[7] * t * r * r + c[8] * t * t * r * r)
    return F.when(t.isNull() | r.isNull(), F.lit(None).cast("double")).when(t < 80, t).otherwise(F.bround(hi, 1))


# ---------------------------------------------------------------------------
# Safe statistics
# ---------------------------------------------------------------------------

def safe_corr(x, y) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an error) for zero variance or < 2 pairs.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when a side is constant.
    """
    xc, yc = _c(x).cast("double"), _c(y).cast("double")
    both = xc.isNotNull() & yc.isNotNull()
    xm, ym = F.when(both, xc), F.when(both, yc)
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))


def safe_div(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def pct(col, p, approx: bool = False, accuracy: int = 10000):
    """Percentile, exact and linearly interpolated by default (pandas/DuckDB ``quantile_cont``).

    Exact ``percentile`` keeps a value->count map per group: its memory follows
    the distinct values of a group (small for quantised sensor readings), and it
    merges map-side.  A caller with an unbounded value domain passes ``approx=True``:
    a fixed-size sketch (``percentile_approx``), no longer equal to interpolated values.
    """
    if approx:
        return F.percentile_approx(_c(col), p, accuracy)
    return F.percentile(_c(col), p)


def first_max(value, order) -> Column:
    """Struct of the row with the largest ``value``, first ``order`` on ties (``idxmax``).

    Use ``.getField('o')`` for the order column; NULL values are ignored.
    """
    v = _c(value)
    return F.min(F.when(v.isNotNull(), F.struct((-v.cast("double")).alias("k"), _c(order).alias("o"),
                                                 v.alias("v"))))
