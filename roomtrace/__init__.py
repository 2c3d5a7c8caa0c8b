"""roomtrace — environmental sensor analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (plus keyword
parameters).  Nothing is collected to the driver; every per-series
computation is keyed by ``device_id`` and, where a single series can be
huge, additionally by a time bucket (see ``operators.series.time_gaps``).
"""

from roomtrace.session import get_spark, checkpoint_dir  # noqa: F401
