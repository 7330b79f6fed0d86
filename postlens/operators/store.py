"""The persistent posting table: upsert, newness, re-gating, orphan repair, vector reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from postlens.operators import classify
from postlens.operators.materialize import cut
from postlens.operators.skew import lookup

# Statuses a person sets; a re-fetched posting must not undo them.
HUMAN_STATUSES = ["reviewed", "apply", "applied", "rejected"]

# Parts of each month, by a hash of the id. Part of the layout: a table keeps the number it was written with.
BUCKETS = 16


def table_key() -> list[Column]:
    return [
        F.col("normalized_title"),
        F.col("company_name"),
        F.coalesce("location", F.lit("")),
        F.coalesce(F.col("posted_date").cast("string"), F.lit("")),
        F.coalesce("source_job_id", "apply_url"),
    ]


def posting_id() -> Column:
    """Row id: hash of the natural key, so the same posting gets the same id everywhere."""
    return F.sha2(F.concat_ws("\x1f", *table_key()), 256)


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", posting_id())


def last_per_key(batch: DataFrame) -> DataFrame:
    """A batch may hold a key more than once: the last row counts, the first names the id.

    One aggregation finds both, so a key's rows are reduced to one per task before the shuffle.
    """
    values = [c for c in batch.columns if c not in ("id", "source_job_id")]
    last = F.max_by(F.struct(*values), F.struct(F.col("seq").isNotNull(), "seq"))
    kept = batch.groupBy("id").agg(last.alias("_last"), F.min_by("source_job_id", "seq").alias("source_job_id"))
    return kept.select("id", "source_job_id", "_last.*")


def upsert(stored: DataFrame, batch: DataFrame, now: Column, legacy_status_overwrite: bool = False) -> DataFrame:
    """The merged table: batch values win, ``source_job_id`` and ``first_seen`` stay, and
    ``last_seen`` moves to ``now``. Both sides hold a key once, so the join cannot skew."""
    values = [c for c in stored.columns if c not in ("id", "source_job_id", "first_seen", "last_seen", "status")]
    old, new = stored.alias("o"), last_per_key(batch).withColumn("_in", F.lit(True)).alias("n")
    given = F.col("n._in").isNotNull()
    status = F.when(given, F.col("n.status")).otherwise(F.col("o.status"))
    if not legacy_status_overwrite:
        status = F.when(F.col("o.status").isin(HUMAN_STATUSES), F.col("o.status")).otherwise(status)
    taken = set(batch.columns)
    return old.join(new, "id", "full").select(
        "id",
        F.when(F.col("o.first_seen").isNotNull(), F.col("o.source_job_id")).otherwise(F.col("n.source_job_id")).alias("source_job_id"),
        *[
            (F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in taken else F.col(f"o.{c}")).alias(c)
            for c in values
        ],
        status.alias("status"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(given, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
    )


def new_postings(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose key is not stored yet (taken before the upsert)."""
    return batch.join(stored.select("id"), "id", "left_anti")


def regate(stored: DataFrame) -> DataFrame:
    """Stored 'new' rows that fail the gates become 'irrelevant'; other statuses stay."""
    overseas = classify.location_class("location") == "overseas"
    fails = (F.col("status") == "new") & (overseas | ~classify.is_relevant("title"))
    return stored.withColumn("status", F.when(fails, F.lit("irrelevant")).otherwise(F.col("status")))


def repair_orphans(stored: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Link duplicates without a canonical to the best surviving sibling, or promote one.

    Per (title, company) one aggregation finds the best scored survivor and the orphan of the
    most preferred source; rows of big groups are dealt over salts for the lookup.
    """
    key = ["normalized_title", "company_name"]
    orphan = (F.col("status") == "duplicate") & F.col("duplicate_of").isNull()
    survivor = ~F.col("status").isin("duplicate", "irrelevant")
    by_score = F.struct(F.col("final_score").isNull(), -F.col("final_score"), "seq", "id")
    by_source = F.struct(classify.source_rank(F.col("source")), "seq", "id")
    facts = stored.groupBy(*key).agg(
        F.min(F.when(survivor, by_score)).alias("s"),
        F.min(F.when(orphan, by_source)).alias("o"),
        F.count("*").alias("n"),
    ).where("o is not null").select(
        *key, F.col("s.id").alias("survivor"), F.col("o.id").alias("best"), "n"
    )
    facts = cut(facts, "orphans")
    joined = lookup(stored, facts, key, "n", "id", hot_rows)
    target = F.coalesce("survivor", "best")
    promoted = orphan & F.col("survivor").isNull() & (F.col("id") == F.col("best"))
    return (
        joined.withColumn("_promoted", promoted)
        .withColumn("duplicate_of", F.when(orphan & ~F.col("_promoted"), target).otherwise(F.col("duplicate_of")))
        .withColumn("status", F.when(F.col("_promoted"), F.lit("new")).otherwise(F.col("status")))
        .drop("survivor", "best", "_promoted")
    )


TEXT_KEY = ["normalized_title", "company_name", "description_hash"]


def embedding_reuse(batch: DataFrame, vectors: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Attach a stored vector of the identical posting text, NULL where it must be computed."""
    best = F.min_by("embedding", F.struct("id", "seq"))
    known = vectors.where("embedding is not null").groupBy(*TEXT_KEY).agg(best.alias("embedding"))
    asked = batch.groupBy(*TEXT_KEY).agg(F.count("*").alias("_n"))
    return lookup(batch, known.join(asked, TEXT_KEY), TEXT_KEY, "_n", "seq", hot_rows)


def encode_new(
    batch: DataFrame, vectors: DataFrame, encoder: Callable[[DataFrame], DataFrame], hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The batch with an ``embedding`` for every row, and the vectors that had to be computed.

    Only texts without a stored vector go to the encoder, each once however many rows have it;
    the second table is what to add to the stored vectors.
    """
    found = cut(embedding_reuse(batch.drop("embedding"), vectors, hot_rows), "encode-found")
    missing = found.where("embedding IS NULL").drop("embedding")
    least = F.min(F.struct("id", "seq")).alias("first")
    texts = missing.groupBy(*TEXT_KEY).agg(least, F.count("*").alias("_n")).select(*TEXT_KEY, "first.*", "_n")
    computed = cut(encoder(texts), "encode-computed")
    told = lookup(missing, computed.select(*TEXT_KEY, "embedding", "_n"), TEXT_KEY, "_n", "seq", hot_rows)
    return found.where("embedding IS NOT NULL").unionByName(told), computed.select("id", "seq", *TEXT_KEY, "embedding")


def month_of(posted: Column) -> Column:
    return F.coalesce(F.date_format(posted, "yyyy-MM"), F.lit("none"))


def bucket_of(row_id: str | Column) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(BUCKETS)).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with the ``month`` and ``bucket`` they are stored in; both follow from the key."""
    return rows.withColumns({"month": month_of(F.col("posted_date")), "bucket": bucket_of("id")})


def touched(rows: DataFrame) -> Column:
    """Condition on the stored table: the parts in which ``rows(id, month)`` lie.

    It names partition columns only, so the other parts are not even listed for reading. Months
    times ``BUCKETS`` bounds what the driver gets.
    """
    parts = rows.select("month", bucket_of("id").alias("bucket")).distinct().collect()
    return F.concat_ws("/", "month", "bucket").isin([f"{p.month}/{p.bucket}" for p in parts])


def read_table(spark, path: str, schema) -> DataFrame:
    """The stored table, empty when nothing was written yet."""
    stored = _stored(spark, path, schema)
    return spark.createDataFrame([], _with_parts(schema)) if stored is None else stored


def _with_parts(schema) -> StructType:
    # The month is declared as text: left to inference, '2026-05' could come back as a date.
    return StructType([*schema.fields, StructField("month", StringType()), StructField("bucket", IntegerType())])


def _stored(spark, path: str, schema) -> DataFrame | None:
    """The stored table, None when nothing was written yet."""
    try:
        return spark.read.schema(_with_parts(schema)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def find(stored: DataFrame, ids: list[str]) -> DataFrame:
    """Stored rows with one of a few ids; only the buckets these can lie in are read. Unknown ids give no row."""
    if not ids:
        return stored.where(F.lit(False))
    return stored.where(F.col("bucket").isin([bucket_of(F.lit(i)) for i in ids]) & F.col("id").isin(ids))


def merge_table(path: str, batch: DataFrame, schema, now: Column) -> DataFrame:
    """Upsert a batch into the table at ``path``, partitioned by posting month and bucket of the id.

    Both derive from the key, so only parts present in the batch can change: just those are
    read, merged and replaced, of undated postings too. The new parts are complete before the table
    is touched, and replaying it gives the same result. A first batch has nothing to be merged with and is
    written as it comes, once.
    """
    spark = batch.sparkSession
    stored = _stored(spark, path, schema)
    if stored is None:
        stored = spark.createDataFrame([], schema)
    else:
        batch = cut(batch.withColumn("month", month_of(F.col("posted_date"))), "merge-batch")
        stored, batch = stored.where(touched(batch)).drop("month", "bucket"), batch.drop("month")
    _replace_parts(placed(upsert(stored, batch, now)), path)
    return read_table(spark, path, schema)


_MAINTAINED = [
    "id", "seq", "source", "title", "normalized_title", "company_name", "location", "posted_date", "status",
    "duplicate_of", "final_score",
]


def maintain(spark, path: str, schema) -> dict[str, int]:
    """Re-gate and repair the stored table, replacing only the parts in which rows change.

    The check reads the few columns it needs; descriptions and scores are read again only for
    the parts to rewrite. Returns how many rows were ``regated``, ``relinked`` and
    ``promoted``, counted as the changes are written. A second call re-gates those of the
    promoted rows that fail the gates, and a third changes nothing.
    """
    slim = read_table(spark, path, schema).select(*_MAINTAINED)
    before = slim.withColumns({"_status": F.col("status"), "_duplicate_of": F.col("duplicate_of")})
    same = F.col("status").eqNullSafe(F.col("_status")) & F.col("duplicate_of").eqNullSafe(F.col("_duplicate_of"))
    counts = Observation("maintenance")
    moved = F.col("status") != F.col("_status")
    changed = repair_orphans(regate(before)).where(~same).observe(
        counts, F.count_if(moved & (F.col("status") == "irrelevant")).alias("regated"),
        F.count_if(~F.col("duplicate_of").eqNullSafe(F.col("_duplicate_of"))).alias("relinked"),
        F.count_if(moved & (F.col("_status") == "duplicate")).alias("promoted"),
    )
    changes = cut(
        changed.select(
            "id", F.col("status").alias("_status"), F.col("duplicate_of").alias("_duplicate_of"),
            month_of(F.col("posted_date")).alias("month"),
        ),
        "maintain-changes",
    )
    set_status(spark, path, schema, changes)
    return {name: int(counts.get[name]) for name in ("regated", "relinked", "promoted")}


def maintain_table(spark, path: str, schema) -> DataFrame:
    """The stored table after :func:`maintain`."""
    maintain(spark, path, schema)
    return read_table(spark, path, schema)


def set_status(spark, path: str, schema, changes: DataFrame, clear: list[str] = ()) -> None:
    """Give the stored rows of ``changes(id, month, _status, _duplicate_of)`` these values, and no value to ``clear``.

    Only the parts the changes lie in are read and replaced.
    """
    if changes.isEmpty():
        return
    stored = read_table(spark, path, schema).where(touched(changes))
    joined = stored.join(changes.drop("month").withColumn("_changed", F.lit(True)), "id", "left")
    for name in ("status", "duplicate_of"):
        joined = joined.withColumn(name, F.when(F.col("_changed"), F.col(f"_{name}")).otherwise(F.col(name)))
    for name in clear:
        joined = joined.withColumn(name, F.when(F.col("_changed"), F.lit(None)).otherwise(F.col(name)))
    _replace_parts(joined.drop("_status", "_duplicate_of", "_changed"), path)


def _replace_parts(rows: DataFrame, path: str) -> None:
    """Put the rows in place of the parts they are of; they may come from these parts.

    Spark stages the new parts in a folder beside them and moves them when the last row is
    written, so nothing that is read goes before, and the rows are written once. Their parts are brought
    together, split again where they are many, so that parts get few files of a good size instead
    of one from every task.
    """
    together = rows.hint("rebalance", F.col("month"), F.col("bucket"))
    writer = together.write.partitionBy("month", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
