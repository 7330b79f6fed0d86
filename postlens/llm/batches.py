"""Arrow batches small enough for long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT, _ROWS = "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python a thousand rows at a time, unless the session says otherwise."""
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, _ROWS)
