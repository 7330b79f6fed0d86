"""Raw postings to normalised postings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.dates import parse_posted_date
from postlens.functions.salary import parse_salary
from postlens.functions.text import clean_text, description_hash, normalize_title

UNKNOWN_COMPANY = "(unknown)"


def normalize(raw: DataFrame, today: date, legacy_dayfirst: bool = False) -> DataFrame:
    """One projection over the raw rows; rows without title or link are dropped."""
    present = raw.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("apply_url", F.lit("")) != ""))
    company = F.trim(F.coalesce("company_name", F.lit("")))
    cleaned = F.when(F.coalesce("description", F.lit("")) != "", clean_text(F.col("description")))
    extra = F.col("extra") if "extra" in raw.columns else F.lit(None).cast("map<string,string>")
    staged = present.select(
        "seq",
        "source",
        "source_job_id",
        "company_id",
        F.when(company == "", F.lit(UNKNOWN_COMPANY)).otherwise(company).alias("company_name"),
        F.trim("title").alias("title"),
        normalize_title(F.col("title")).alias("normalized_title"),
        "location",
        parse_posted_date(F.col("posted_date_raw"), today, legacy_dayfirst).alias("posted_date"),
        "apply_url",
        cleaned.alias("description"),
        parse_salary(F.col("salary_raw")).alias("salary"),
        "salary_raw",
        extra.alias("extra"),
    )
    return staged.select(
        "seq", "source", "source_job_id", "company_id", "company_name", "title", "normalized_title", "location",
        "posted_date", "apply_url", "description",
        description_hash(F.col("description"), squashed=True).alias("description_hash"),
        F.col("salary.min").alias("salary_min"),
        F.col("salary.max").alias("salary_max"),
        F.col("salary.currency").alias("salary_currency"),
        F.col("salary.period").alias("salary_period"),
        "salary_raw", "extra",
        F.lit("new").alias("status"),
    )
