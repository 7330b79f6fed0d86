"""Incremental runs: the batch functions under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postlens.operators.materialize import cut
from postlens.operators.store import merge_table
from postlens.plans.pipeline import run_batch
from postlens.session import spread


def file_stream(spark: SparkSession, table: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Rows of a table as its files land; the table is a folder of files or one file.

    A pattern that fits the table alone stands for either, where a plain path must be a folder.
    """
    pattern = f"{table[:-1]}[{table[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def batch_clock(spark: SparkSession, log: str, batch_id: int) -> datetime:
    """The time at which a batch was first taken up, from a small log beside the checkpoint.

    A replayed batch finds its time there, so it stores what it stored before.
    """
    path = f"{log}/batch={batch_id}"
    try:
        return spark.read.schema("taken timestamp").parquet(path).first()["taken"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.sql("SELECT current_timestamp() AS taken").coalesce(1).write.parquet(path)
    return spark.read.schema("taken timestamp").parquet(path).first()["taken"]


def ingest(
    landed: DataFrame, to_postings: Callable[[DataFrame], DataFrame], table: str, schema: StructType, checkpoint: str
) -> StreamingQuery:
    """Upsert every newly landed file into the posting table, then stop.

    The upsert is keyed and a batch keeps the time of its first attempt, so a replayed batch
    leaves the table as it was.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = F.lit(batch_clock(batch.sparkSession, f"{checkpoint.rstrip('/')}-clock", batch_id))
        merge_table(table, to_postings(batch), schema, now)

    return (
        landed.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_stream(
    landed: DataFrame,
    to_raw: Callable[[DataFrame], DataFrame],
    companies: DataFrame,
    ratings: DataFrame,
    with_similarity: Callable[[DataFrame], DataFrame] | None,
    today: date,
    table: str,
    index: str,
    checkpoint: str,
    alerts: str | None = None,
    hot_rows: int | None = None,
) -> StreamingQuery:
    """The whole run over newly landed files, batch by batch, then stop.

    Every batch resolves, scores and stores its postings against what is there (see
    :func:`postlens.plans.pipeline.run_batch`) and logs its digest to ``alerts``. A replayed
    batch has its first time and number, so table, index and log stay as they were. A file that few
    tasks would read, as one of few row groups, is dealt over all cores before its texts are worked on.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = batch_clock(spark, f"{checkpoint.rstrip('/')}-clock", batch_id)
        run_batch(
            to_raw(spread(batch)), batch_id, companies, ratings, with_similarity, today, F.lit(taken), table, index,
            hot_rows=hot_rows, alerts_path=alerts,
        )

    return landed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_first(stream: DataFrame, key: list[str], ts: str, days: int = 21) -> DataFrame:
    """The first row of a key to arrive within the window; rows later than the watermark are dropped.

    Of rows that arrive together any may be the first; for the earliest by time, and the late rows, see
    :func:`postlens.streaming.firsts.keep_earliest`, on tables :func:`postlens.sources.landing.keep_first`.
    """
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(key)


def daily_counts(events: DataFrame, ts: str, source: str, late_days: int | None = None) -> DataFrame:
    """Rows per source and day; works on a stream and on a table alike.

    On a stream ``late_days`` bounds the state: a day is closed, and its rows no longer
    counted, that many days after the latest row seen.
    """
    if late_days is not None:
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late_days} days")
    day = F.window(ts, "1 day")
    return (
        events.groupBy(day.alias("w"), F.col(source).alias("source"))
        .agg(F.count("*").alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "source", "n")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_days(changed: DataFrame, path: str) -> None:
    """Put new counts into the table of days at ``path``; only the days they are of are read and replaced.

    Counts are whole, not increments, so merging the same ones again changes nothing.
    """
    spark = changed.sparkSession
    changed = cut(changed.select("day", "source", "n"), "days-changed")
    days = [r.day for r in changed.select("day").distinct().collect()]  # those not closed yet
    if not days:
        return
    try:
        stored = spark.read.schema("source string, n long, day string").parquet(path).where(F.col("day").isin(days))
        same = (stored["day"] == changed["day"]) & stored["source"].eqNullSafe(changed["source"])
        changed = cut(stored.join(changed, same, "left_anti").unionByName(changed), "days-staged")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    changed.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def keep_days(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep daily counts at ``path``: every batch brings the counts it changed and its days are replaced."""
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda df, _: merge_days(df, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
