"""Presentation of results for sinks and comparisons.

Sinks write records with ISO timestamp text (as the reference's payload
does).  ``present`` applies the same rule to any result frame: doubles
rounded to 6 digits, timestamps and dates as text, narrow integers widened
to BIGINT.  ``present_sql`` wraps DuckDB SQL the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtrace.functions.exprs import iso_str

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S.%f"
DIGITS = 6


def present(df: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """Columns in the form of a payload; ``digits=None`` leaves doubles unrounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if digits is None and isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            pass
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # round(x * 10^d) / 10^d: both engines form the same IEEE product and round it
            # half away from zero, so ties at the last digit agree.
            c = F.round(c.cast("double") * float(10 ** digits), 0) / float(10 ** digits)
        elif isinstance(t, T.TimestampNTZType):
            c = iso_str(c)
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, TS_FMT_SPARK)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def present_sql(inner: str, doubles=(), ts=(), dates=(), ints=(), digits: int = DIGITS) -> str:
    """``select * replace (...)`` over ``inner`` with the same rules as ``present``."""
    scale = f"{float(10 ** digits)}"
    rep = [f"round(cast({c} as double) * {scale}) / {scale} as {c}" for c in doubles]
    rep += [f"strftime({c}, '{TS_FMT_DUCK}') as {c}" for c in ts]
    rep += [f"strftime({c}, '%Y-%m-%d') as {c}" for c in dates]
    rep += [f"cast({c} as bigint) as {c}" for c in ints]
    if not rep:
        return inner
    return f"select * replace ({', '.join(rep)}) from (\n{inner}\n) q"
