"""Cut lineage by writing an intermediate table to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postlens.session import scratch_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: survives executor loss, and the planner knows the real size."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
