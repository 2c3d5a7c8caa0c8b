"""Registry of named queries: a Spark plan plus its DuckDB restatement.

Each entry reads the driver's tables through the fixtures, runs one
operator (or a short chain) and returns a presented DataFrame.  The SQL
text is the oracle for the same result.  Queries are grouped by module
(``catalog_*.py``) and registered on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomtrace.functions.timefn import localize
from roomtrace.operators.clean import clean_mask
from roomtrace.plans.present import present, present_sql
from roomtrace.sources.fixtures import readings_r1, readings_r2, readings_r3, weather_w1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, sql: str | None = None, doubles=(), ts=(), dates=(), ints=(), presented: bool = False):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``presented``: ``fn`` has presented its rows."""

    def deco(fn):
        RAW[name] = fn
        QUERIES[name] = fn if presented else lambda spark, sf_dir, _fn=fn: present(_fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = present_sql(sql, doubles=doubles, ts=ts, dates=dates, ints=ints)
        return fn

    return deco


# --- shared inputs --------------------------------------------------------

def raw(spark: SparkSession, sf_dir: str, fixture: str = "r1") -> DataFrame:
    return {"r1": readings_r1, "r2": readings_r2, "r3": readings_r3}[fixture](spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str, fixture: str = "r1") -> DataFrame:
    return clean_mask(raw(spark, sf_dir, fixture))


def loc(spark: SparkSession, sf_dir: str, fixture: str = "r1") -> DataFrame:
    return localize(clean(spark, sf_dir, fixture))


def weather(spark: SparkSession) -> DataFrame:
    return weather_w1(spark)


def load_all() -> None:
    """Import every catalog module so that its queries register."""
    from roomtrace.plans import (  # noqa: F401
        catalog_core,
        catalog_profiles,
        catalog_color,
        catalog_stats,
        catalog_anomalies,
        catalog_quality,
        catalog_sections,
        catalog_effects,
    )
