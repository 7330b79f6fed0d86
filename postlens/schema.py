"""Column types of the row kinds that flow between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_POSTING = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("apply_url", T.StringType()),
        T.StructField("source_job_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("posted_date_raw", T.StringType()),
        T.StructField("salary_raw", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_job_id", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("normalized_title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("posted_date", T.DateType()),
        T.StructField("apply_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("description_hash", T.StringType()),
        T.StructField("salary_min", T.LongType()),
        T.StructField("salary_max", T.LongType()),
        T.StructField("salary_currency", T.StringType()),
        T.StructField("salary_period", T.StringType()),
        T.StructField("salary_raw", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("semantic_score", T.DoubleType()),
        T.StructField("seniority_score", T.DoubleType()),
        T.StructField("industry_score", T.DoubleType()),
        T.StructField("company_score", T.DoubleType()),
        T.StructField("location_score", T.DoubleType()),
        T.StructField("final_score", T.DoubleType()),
        T.StructField("priority_tier", T.StringType()),
        T.StructField("strong_alert", T.BooleanType()),
        T.StructField("match_reasons", T.ArrayType(T.StringType())),
        T.StructField("resume_tips", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)

# One landed response body per row; feed parsers read only this.
PAYLOAD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("base_url", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("priority_tier", T.StringType()),
        T.StructField("strong_alert", T.BooleanType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("payload_ref", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema: absent columns become typed NULLs, extra ones are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
