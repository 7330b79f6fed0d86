"""Dimension lookups: companies and star ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.rules import text_literal
from postlens.functions.text import normalize_company
from postlens.packs import food_au as pack


def _local(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A pack table as literal rows: the planner knows its size and broadcasts it by itself."""

    def literal(value) -> str:
        return text_literal(value) if isinstance(value, str) else str(value).lower()

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def companies(spark: SparkSession) -> DataFrame:
    return _local(spark, pack.COMPANIES, "company_id, name, sector, priority_tier, adapter, active")


def ratings(spark: SparkSession) -> DataFrame:
    """Ratings keyed by normalised company name; a later entry of the same key wins."""
    rows = [(i, name, stars) for i, (name, stars) in enumerate(pack.RATINGS.items())]
    keyed = _local(spark, rows, "pos, name, stars").groupBy(normalize_company(F.col("name")).alias("company_key"))
    return keyed.agg(F.max_by("stars", "pos").alias("stars"))


def enrich_companies(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Add sector, is_tier1 and is_recruiter from the company dimension.

    No join hint: the planner broadcasts the dimension while its measured size allows and
    shuffles beyond that.
    """
    slim = dim.select(
        "company_id",
        F.col("sector").alias("_sector"),
        (F.upper("priority_tier") == "P1").alias("_tier1"),
        (F.lower("sector") == "aggregator").alias("_aggregator"),
    )
    name = F.lower(F.coalesce(F.col("company_name"), F.lit("")))
    by_name = name.contains("recruit") | name.contains("agency")
    known = F.col("_sector").isNotNull()
    return (
        df.join(slim, "company_id", "left")
        .withColumn("sector", F.coalesce("_sector", F.lit("")))
        .withColumn("is_tier1", F.coalesce("_tier1", F.lit(False)))
        .withColumn("is_recruiter", F.when(known, F.col("_aggregator")).otherwise(by_name))
        .drop("_sector", "_tier1", "_aggregator")
    )


def with_stars(df: DataFrame, rated: DataFrame, company: Column | None = None) -> DataFrame:
    """Add the star rating of the normalised company name, the default where unrated."""
    key = normalize_company(F.col("company_name") if company is None else company)
    joined = df.withColumn("_key", key).join(
        rated.select(F.col("company_key").alias("_key"), F.col("stars").alias("_stars")), "_key", "left"
    )
    return joined.withColumn("stars", F.coalesce("_stars", F.lit(pack.DEFAULT_STARS))).drop("_key", "_stars")
