"""Ranked views of scored postings: selection, sections, top lists, counts, alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postlens.functions.display import digest_lines as lines_of
from postlens.functions.display import format_salary
from postlens.operators import classify
from postlens.operators.score import tier_rank
from postlens.packs import food_au as pack

HIDDEN_STATUSES = ["duplicate", "irrelevant", "expired"]


def by_score() -> list[Column]:
    return [F.col("final_score").desc_nulls_last(), F.col("seq").asc()]


def select_for_digest(df: DataFrame, min_tier: str = "C", home_only: bool = True) -> DataFrame:
    """Rows worth reporting: relevant, at least the minimum tier, not clearly elsewhere."""
    limit = pack.TIER_RANK.get(min_tier.upper(), 3)
    kept = df.where(
        (F.col("status") != "irrelevant")
        & F.col("priority_tier").isNotNull()
        & (tier_rank("priority_tier") <= limit)
    )
    if home_only:
        kept = kept.where(classify.region("location", "title") != "other")
    return kept


def top_jobs(df: DataFrame, limit: int = 50, min_score: float = 0.0) -> DataFrame:
    shown = df.where((F.col("final_score") >= min_score) & ~F.col("status").isin(HIDDEN_STATUSES))
    return shown.orderBy(*by_score()).limit(limit)


def seen_since(df: DataFrame, column: str, since: datetime, order: list[Column]) -> DataFrame:
    return df.where(F.col(column) >= F.lit(since)).orderBy(*order)


def report_sections(df: DataFrame) -> DataFrame:
    """Postings with their section (1 preferred, 2 board picks, 3 other regions).

    Sections overlap by design. Section 3 keeps the best row per link, so it alone is shuffled;
    its ``= 1`` filter is applied before that.
    """
    placed = df.withColumn("_else", classify.region("location", "title") == "other")
    plain = F.array_compact(
        F.array(
            F.when(F.col("source") == pack.SOURCE_PREFERENCE[0], F.lit(1)),
            F.when(F.col("source").isin(pack.AGGREGATORS) & ~F.col("_else"), F.lit(2)),
        )
    )
    first_two = placed.withColumn("section", F.explode(plain)).drop("_else")
    rank = F.row_number().over(W.partitionBy("apply_url").orderBy(*by_score()))
    third = placed.where("_else").withColumn("section", F.lit(3)).withColumn("_rn", rank).where("_rn = 1")
    return first_two.unionByName(third.drop("_rn", "_else"))


def section_heading() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in pack.SECTIONS]), F.col("section"))


def top_n_per_section(sections: DataFrame, n: int = pack.EMAIL_TOP_N) -> DataFrame:
    """The first ``n`` of each section; map tasks keep ``n`` rows per section before shuffling."""
    rank = F.row_number().over(W.partitionBy("section").orderBy(*by_score()))
    return sections.withColumn("rank", rank).where(F.col("rank") <= n)


def tier_counts(df: DataFrame) -> DataFrame:
    """Rows per tier in fixed order, 'Unscored' last; only tiers that occur."""
    tier = F.coalesce("priority_tier", F.lit("Unscored")).alias("tier")
    position = F.when(F.col("tier") == "Unscored", F.lit(5)).otherwise(tier_rank("tier"))
    return df.groupBy(tier).agg(F.count("*").alias("n")).withColumn("position", position).orderBy("position")


def section_counts(sections: DataFrame) -> DataFrame:
    return sections.groupBy("section").agg(F.count("*").alias("n"))


def digest_summary(digest: DataFrame) -> DataFrame:
    urgent = F.col("strong_alert") | (F.coalesce("priority_tier", F.lit("")) == "A+")
    return digest.agg(F.count("*").alias("roles"), F.count_if(urgent).alias("high_priority"))


def alerts(digest: DataFrame, run_id: str, channel: str, sent_at: Column) -> DataFrame:
    """One log row per posting sent; ``log_alerts`` stores it."""
    return digest.select(
        F.col("id").alias("job_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(channel).alias("channel"),
        "priority_tier",
        "strong_alert",
        sent_at.alias("sent_at"),
        F.lit(None).cast("string").alias("payload_ref"),
    )


def log_alerts(rows: DataFrame, path: str) -> None:
    """Add alert rows to the log; a repeated run id replaces its own rows."""
    writer = rows.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_report(sections: DataFrame, path: str) -> None:
    """Store the report's sections, each in its own folder and in score order within its files."""
    ordered = sections.repartitionByRange("section", *by_score()).sortWithinPartitions("section", *by_score())
    ordered.write.partitionBy("section").mode("overwrite").parquet(path)


def digest_lines(top: DataFrame) -> DataFrame:
    """The text block of each listed posting (``top`` carries section, rank and stars)."""
    names = ["title", "company_name", "location", "final_score", "priority_tier", "stars", "apply_url"]
    cols = {n: F.col(n) for n in names}
    cols["salary_text"] = format_salary(
        F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"), F.col("salary_raw")
    )
    return top.select("section", "rank", "seq", lines_of(cols).alias("lines"))
