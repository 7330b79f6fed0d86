"""Keep-first by event time on a stream, with the rows that come too late as an output of their own."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

DAY = 86_400_000_000  # microseconds

_CHAINS = "key string, start long, end long, told boolean, row string, first boolean, open boolean"
_MARK = "batch long, latest long"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PARTS = ["kind", "_batch"]


def add_time(chains: list[tuple], t: int, row: str, gap: int) -> list[tuple]:
    """The chains ``(start, end, told, row)`` of one key after a row at ``t``, ordered by start.

    A chain is a run of rows none of which is more than ``gap`` after the one before; ``row`` is
    its first, the smallest text of those at one time. The result does not depend on the order in which rows are added.
    This is the rule for one row; :func:`_joined` does it for all keys of a batch at once.
    """
    near = [c for c in chains if c[0] - gap <= t <= c[1] + gap]
    told = any(c[2] for c in near)
    # A told chain began before the watermark and so before any row that is still accepted.
    first = min([(c[0], c[3]) for c in near if c[2] or not told] + ([] if told else [(t, row)]))
    grown = (first[0], max([t, *(c[1] for c in near)]), told, first[1])
    return sorted([c for c in chains if c not in near] + [grown])


@dataclass(frozen=True)
class Earliest:
    """What :func:`start` does with a stream: see :func:`keep_earliest`. ``gap`` is in micro-, ``late`` in milliseconds."""

    stream: DataFrame
    key: list[str]
    ts: str
    gap: int
    late: int

    def time(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp"))


def keep_earliest(stream: DataFrame, key: list[str], ts: str, gap_days: float, late_days: float) -> Earliest:
    """The rows of ``stream`` that matter, with a column ``kind``, as :func:`start` writes them.

    ``first``: the earliest row by ``ts`` of every chain of a key, a chain being rows none of which
    lies more than ``gap_days`` after the one before. It is put out once, when the watermark
    (``late_days`` behind the latest row of earlier batches) has passed it, so nothing that is still
    accepted can precede it; in which order and batch the rows came makes no difference. Rows at or
    behind the watermark are not lost: they come out as ``late`` and take no part in chains, rows
    without ``ts`` as ``undated``. Keys may be null, and nulls are equal. Rows at the same
    time: the one whose JSON text is smallest is first. An empty stream gives no rows.

    Rows of a key that lie in one stretch of ``gap_days`` belong together whatever lies between, so they
    are reduced to one in the tasks that read them: what a hot key costs is bounded by the days it spans.
    The state is the chains that can still grow; every batch reads and writes all of it.
    """
    return Earliest(stream, key, ts, round(gap_days * DAY), int(late_days * 86_400) * 1000)


def _fresh(told: Earliest, batch: DataFrame, mark: int | None) -> DataFrame:
    """The batch's rows that are on time, as chains of one stretch of the gap each."""
    rows = batch.where(told.time().isNotNull() if mark is None else told.time() >= (mark + 1) * 1000).select(
        F.to_json(F.struct(*told.key), {**_JSON, "ignoreNullFields": "false"}).alias("key"),
        told.time().alias("t"),
        F.to_json(F.struct(*batch.columns), _JSON).alias("row"),
    )
    stretch = F.col("t") - F.pmod("t", F.lit(max(told.gap, 1)))
    found = rows.groupBy("key", stretch.alias("stretch")).agg(F.min(F.struct("t", "row")).alias("f"), F.max("t").alias("end"))
    return found.select("key", F.col("f.t").alias("start"), "end", F.lit(False).alias("told"), F.col("f.row").alias("row"))


def _joined(chains: DataFrame, gap: int) -> DataFrame:
    """The chains with those put together that lie no more than ``gap`` apart.

    A told chain began before the watermark and so before any row that is still accepted: it stays first.
    """
    by_start = W.partitionBy("key").orderBy("start")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    apart = F.when(F.col("start") <= reach + gap, 0).otherwise(1)
    numbered = chains.withColumn("_apart", apart).withColumn(
        "_chain", F.sum("_apart").over(by_start.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    whole = numbered.groupBy("key", "_chain").agg(
        F.min(F.struct("start", "row")).alias("f"), F.max("end").alias("end"), F.max("told").alias("told")
    )
    return whole.select("key", "f.start", "end", "told", "f.row")


def _mark(latest: int | None, late: int) -> int | None:
    """The watermark in milliseconds."""
    return None if latest is None else latest // 1000 - late


def _stored(spark: SparkSession, state: str, batch_id: int) -> tuple[DataFrame | None, int | None]:
    """The open chains after a batch and the latest time up to it."""
    if batch_id < 0:
        return None, None
    slot = f"{state}/slot={batch_id % 2}"
    try:
        found = spark.read.schema(_MARK).parquet(f"{slot}/mark").where(F.col("batch") == batch_id).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        raise RuntimeError(f"no chains of batch {batch_id} in {state}: it belongs to another checkpoint")
    chains = spark.read.schema(_CHAINS).parquet(f"{slot}/chains").where("open")
    return chains.select("key", "start", "end", "told", "row"), found["latest"]


def _put(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write rows to their kind's folder; a repeated batch replaces what it wrote."""
    writer = rows.withColumn("_batch", F.lit(batch_id)).write.partitionBy(*_PARTS).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def take(told: Earliest, batch: DataFrame, batch_id: int, path: str, state: str) -> None:
    """One batch: rows late or undated and firsts that are certain go to ``path``, chains that may grow to ``state``.

    The state has two slots; a batch reads that of the batch before and writes the other, its
    mark last, so a batch that is repeated finds what it found before.
    """
    spark = batch.sparkSession
    chains, latest = _stored(spark, state, batch_id - 1)
    before = _mark(latest, told.late)
    seen = batch.agg(F.max(told.time()).alias("t")).first()["t"]
    latest = max([t for t in (latest, seen) if t is not None], default=None)
    kind = F.when(told.time().isNull(), F.lit("undated"))
    if before is not None:
        kind = kind.when(told.time() < (before + 1) * 1000, F.lit("late"))
    _put(batch.withColumn("kind", kind).where("kind IS NOT NULL"), batch_id, path)

    fresh = _fresh(told, batch, before)
    whole = _joined(fresh if chains is None else chains.unionByName(fresh), told.gap)
    over = F.lit(_mark(latest, told.late)).cast("long")
    passed = F.coalesce(F.col("start") < (over + 1) * 1000, F.lit(False))
    marked = whole.select(
        "key", "start", "end", (F.col("told") | passed).alias("told"), "row", (~F.col("told") & passed).alias("first"),
        F.coalesce(F.col("end") + told.gap >= (over + 1) * 1000, F.lit(True)).alias("open"),
    )
    slot = f"{state}/slot={batch_id % 2}"
    marked.where("first OR open").write.mode("overwrite").parquet(f"{slot}/chains")
    firsts = spark.read.schema(_CHAINS).parquet(f"{slot}/chains").where("first")
    rows = firsts.select(F.from_json("row", batch.schema, _JSON).alias("r")).select("r.*", F.lit("first").alias("kind"))
    _put(rows, batch_id, path)
    mark = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(latest).cast("long").alias("latest"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{slot}/mark")


@contextmanager
def _settings(spark: SparkSession, partitions: int | None):
    """A stream copies the settings when it starts, then the caller's return."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if partitions:
            spark.conf.set(name, str(partitions))
        yield
    finally:
        spark.conf.set(name, before)


def start(told: Earliest, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Append the rows of :func:`keep_earliest` to a table at ``path``, a folder per kind and in it per batch, then stop.

    Firsts that the watermark has not passed stay beside the checkpoint, in ``<checkpoint>-chains``, for
    the next start. ``partitions`` (the session's shuffle partitions if not given) is how many tasks a batch is dealt over.
    """
    spark = told.stream.sparkSession
    state = f"{checkpoint.rstrip('/')}-chains"
    none = spark.createDataFrame([], told.stream.schema).withColumns({"kind": F.lit("first"), "_batch": F.lit(0)})
    none.write.partitionBy(*_PARTS).mode("append").parquet(path)  # there also if no file has landed
    with _settings(spark, partitions):
        return (
            told.stream.writeStream.foreachBatch(lambda batch, batch_id: take(told, batch, batch_id, path, state))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
