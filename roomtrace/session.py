"""Session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
from the session and only fall back to a fresh scratch folder when it is
unset (local tests).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job wants; they are idempotent and cheap.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Exact percentiles are object-hash aggregates; the default falls back to a full sort after
    # 128 keys per task, which every hourly/daily grain exceeds.  4096 keys stays memory-bounded.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "roomtrace",
              tz: str = "UTC", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks.  Results do not depend on ``tz``: all
    timestamps are TIMESTAMP_NTZ and every operator avoids zone-dependent functions."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", tz)
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:
        d = None
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # pragma: no cover - Spark Connect sessions have no SparkContext
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is not None and not sc.master.startswith("local") or sc is not None and sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="roomtrace-ckpt-")  # unset: local runs and tests only
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # pragma: no cover - static conf on some deployments
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
