"""Source outcomes, run totals and health, computed from landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_stats(companies: DataFrame, rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Outcome per active source: rows fetched, 'empty' without any, else the recorded failure.

    ``failures(company_id, status)`` carries 'blocked' or 'error' outcomes.
    """
    counts = rows.groupBy("company_id").agg(F.count("*").alias("fetched"))
    joined = companies.where("active").join(counts, "company_id", "left")
    fetched = F.coalesce("fetched", F.lit(0)).cast("bigint")
    status = F.when(fetched > 0, F.lit("ok")).otherwise(F.lit("empty"))
    if failures is not None:
        known = failures.groupBy("company_id").agg(F.min("status").alias("_failure"))
        joined = joined.join(known, "company_id", "left")
        status = F.coalesce(F.col("_failure"), status)
    return joined.select("company_id", "name", "priority_tier", status.alias("status"), fetched.alias("fetched"))


def run_stats(stats: DataFrame, run: Column) -> DataFrame:
    """Totals per run: sources, rows, and sources by outcome."""
    status = F.col("status")
    return stats.groupBy(run.alias("run_id")).agg(
        F.count("*").alias("sources"),
        F.sum("fetched").alias("raw_fetched"),
        F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "blocked").alias("blocked"),
        F.count_if(status == "error").alias("errors"),
    )


def source_health(stats: DataFrame) -> DataFrame:
    """Health row per source; a run passes when no top-priority source is unhealthy."""
    ok = F.col("status") == "ok"
    return stats.select(
        "company_id", "name", "status", ok.alias("ok"), F.col("fetched").alias("job_count"),
        (~ok & (F.col("priority_tier") == "P1")).alias("failing"),
    )


def gate_passes(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if("failing").alias("failing")).withColumn("passes", F.col("failing") == 0)
