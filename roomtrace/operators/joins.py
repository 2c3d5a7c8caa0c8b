"""Joining per-key statistics back to large frames.

Statistics computed by an aggregate (one row per device, device-day, device-sensor, ...) are joined
back to raw rows in many operators.  The join is left to Spark: adaptive execution broadcasts a side
whose measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both,
splitting skewed keys (one device may hold a third of all rows).  Building a query runs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """``big.join(small, on, how)``; the join's form is chosen from sizes measured at run time."""
    return big.join(small, on, how)


def join_null_safe(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``join_small`` in which NULL keys meet.  No ``IS NOT NULL`` filter is derived from it, so frames that read
    one aggregate keep one plan of it and reuse its exchange."""
    other = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & big[c].eqNullSafe(other[f"_on_{c}"])
    return big.join(other, cond, how).drop(*[f"_on_{c}" for c in on])
