"""RSS feeds to raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import blank_to_null, clean_text, title_tail_location
from postlens.operators.materialize import cut
from postlens.sources.json_feeds import carried, finished

# The feed's element names, with and without the location prefix.
RSS = (
    "channel struct<item:array<struct<title:string, link:string, description:string, guid:string, pubDate:string, "
    "`g:location`:string, location:string>>>"
)


def rss(payloads: DataFrame, outer: bool = False) -> DataFrame:
    """One row per item with a title or link; malformed documents contribute nothing.

    With ``outer`` as in the JSON feeds; a document without items is a fault.
    """
    items = F.from_xml("payload", RSS)["channel"]["item"]
    keys = carried(payloads, "source", "company_id", "company_name", "page_no")
    listed = payloads.select(*keys, items.alias("items"))
    told = listed.select(*keys, F.when(F.col("items").isNull(), F.lit("no_rows")).alias("fault"), "items")
    return rss_items(told.select(*keys, "fault", F.posexplode_outer("items").alias("pos", "r")), outer)


def rss_items(rows: DataFrame, outer: bool = False) -> DataFrame:
    """Raw postings of feed items ``r``, whatever brought them."""

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"r.`{name}`"), F.lit("")))

    place = F.coalesce(
        blank_to_null(text("g:location")), blank_to_null(text("location")), title_tail_location(text("title"))
    )
    named = rows.select(
        *carried(rows, "source", "company_id", "page_no", "pos", "fault"),
        text("title").alias("title"),
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        text("link").alias("apply_url"),
        blank_to_null(text("guid")).alias("source_job_id"),
        blank_to_null(place).alias("location"),
        blank_to_null(clean_text(text("description"))).alias("description"),
        blank_to_null(text("pubDate")).alias("posted_date_raw"),
    )
    return finished(named, (F.col("title") != "") | (F.col("apply_url") != ""), outer)


def rss_files(spark: SparkSession, path: str, source: str, company_id: str, company_name: str) -> tuple[DataFrame, DataFrame]:
    """Raw postings of the feed files at ``path``, and ``(file, reason)`` of those that hold none.

    Spark's XML reader takes a document a row and keeps what it can't read, so a broken file
    costs only itself.
    """
    schema = T.StructType([*T._parse_datatype_string(RSS).fields, T.StructField("_broken", T.StringType())])
    options = {"rowTag": "rss", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    read = spark.read.schema(schema).options(**options).format("xml").load(path).withColumn("file", F.col("_metadata.file_path"))
    docs = cut(read.select("file", F.col("channel.item").alias("items"), F.col("_broken").isNotNull().alias("broken")), "feed-files")
    named = docs.select(
        F.lit(source).alias("source"), F.lit(company_id).alias("company_id"), F.lit(company_name).alias("company_name"),
        F.lit(None).cast("long").alias("page_no"), F.lit(None).cast("string").alias("fault"), F.col("file").alias("body"),
        F.posexplode("items").alias("pos", "r"),
    )
    rows = rss_items(named).withColumnRenamed("body", "file")
    reason = F.when(F.max("broken"), F.lit("malformed")).otherwise(F.lit("no_rows"))
    held = docs.groupBy("file").agg(F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("n"), reason.alias("reason"))
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    errors = listed.join(held, "file", "left").where(F.coalesce("n", F.lit(0)) <= 0)
    return rows, errors.select("file", F.coalesce("reason", F.lit("malformed")).alias("reason"))
