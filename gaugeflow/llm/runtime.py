"""Session settings of the operators, and the stored tables they share with the rest of the package."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gaugeflow.scratch import BROADCAST_ROWS, discard, materialize, scratch_path, shared_dir, sided

__all__ = ["BROADCAST_ROWS", "SETTINGS", "discard", "materialize", "prepare", "scratch_path", "shared_dir", "sided"]

#: Settings the operators rely on.  Arrow batches are bounded in bytes, so long
#: texts cannot inflate a Python worker; shuffle files go when their query ends.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
