"""Entity resolution batch by batch, over a stored index of what earlier batches held.

All that resolution compares lies within one title core and company (or, where either is
blank, one title and company): its unit. A batch can change clusters in its own units only,
so of the index just these are read. The index has a row per natural key and posting id, and
its columns are minima and maxima, so a batch is appended as it is and rows are merged when
read; a batch that is repeated replaces its own part.

Rows are ordered by (batch, seq). What came first stays first, so representatives never
change and clusters only grow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators import resolve
from postlens.operators.materialize import cut
from postlens.operators.skew import lookup
from postlens.operators.store import month_of

BUCKETS = 64
_ORDER = T.DecimalType(38, 0)  # batch * 2**63 + seq
_KEY = ["unit", "bucket", *resolve._K1, "id"]
_REP = ["seq", *resolve._K2, *resolve._NODE]


def _unit() -> Column:
    block = F.xxhash64(*resolve._BLOCK)
    return F.when(F.col("ba").isNotNull(), block).otherwise(F.xxhash64("normalized_title", F.trim(F.lower("company_name"))))


def entries(postings: DataFrame, batch_id: int, buckets: int = BUCKETS) -> DataFrame:
    """Index rows of a batch of normalised postings with ``id``."""
    ordered = postings.withColumn("seq", (F.lit(Decimal(batch_id << 63)) + F.col("seq")).cast(_ORDER))
    names = ["id", "normalized_title", "company_name", month_of(F.col("posted_date")).alias("month"), resolve.preference().alias("pref")]
    rows = resolve.slim(ordered, *names).withColumn("unit", _unit())
    rows = rows.withColumns({"bucket": F.pmod("unit", F.lit(buckets)).cast("int"), "rep": F.struct(*_REP), "last": F.col("seq")})
    return _merged(rows.select(*_KEY, "month", "rep", "pref", "last"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(
        F.min("month").alias("month"), F.min("rep").alias("rep"), F.min("pref").alias("pref"), F.max("last").alias("last")
    )


def read_index(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resolve_batch(path: str, postings: DataFrame, batch_id: int, hot_rows: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(id, month, canonical)`` of all postings, of this and earlier batches, in the units of the batch.

    ``canonical`` is the id of the best posting of the cluster. The batch joins the index at
    ``path``; a batch id taken again replaces what it wrote. An id whose rows fell into
    several clusters belongs to that of its last row.
    """
    spark = postings.sparkSession
    mine = cut(entries(postings, batch_id, buckets), "index-entries")
    touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # at most ``buckets``
    known = read_index(spark, path, mine.schema)
    together = mine
    if known is not None:
        old = known.where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id))
        old = old.join(mine.select("unit").distinct(), "unit", "left_semi").select(*mine.columns)
        together = cut(_merged(old.unionByName(mine)), "index-together")
    keyed = together.groupBy(*resolve._K1).agg(F.min("rep").alias("rep"), F.count("*").alias("n")).select(*resolve._K1, "rep.*", "n")
    by_key = resolve.key_clusters(cut(keyed, "index-keys"), hot_rows)
    named = lookup(together.select(*resolve._K1, "id", "month", "pref", "last"), by_key, resolve._K1, "n", "id", hot_rows)
    named = cut(named.select("id", "month", "pref", "last", "cluster"), "index-named")
    best = named.groupBy("cluster").agg(F.min_by("id", "pref").alias("canonical"), F.count("*").alias("n"))
    linked = lookup(named, cut(best, "index-best"), ["cluster"], "n", "id", hot_rows)
    links = linked.groupBy("id").agg(F.min("month").alias("month"), F.max_by("canonical", "last").alias("canonical"))
    links = cut(links, "index-links")
    mine.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return links
