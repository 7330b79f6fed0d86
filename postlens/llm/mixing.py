"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.numbering import number_rows
from postlens.operators.materialize import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
BROADCAST_SOURCES = 100_000  # rows of one string and a few numbers; more are joined by shuffle
MARK = "_mx_mark"
_UNIT_DIGITS = 13  # hexadecimal digits of the draw: 52 bits, exact in a double


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, int]:
    """``(source, source_size, weight, target)`` per source, and the number of sources.

    Weights repeat along the sources in code point order, null last. All sizes together are
    shared by weight; a source stops at ``MAX_REPEATS`` times its size and the excess is
    reshared. The level, words per unit of weight, only rises from round to round, and each
    round is one aggregate over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered, n = number_rows(sums, [F.col("source").asc_nulls_last()], "mix-sources", "_mx_no")
    weights = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod("_mx_no", F.lit(len(cycle))) + 1).cast("int"))
    sources = numbered.select("source", "source_size", weights.cast("long").alias("weight"))
    cap = F.col("source_size") * MAX_REPEATS
    level = 0.0
    while True:
        capped = cap < F.lit(level) * F.col("weight")
        total, at_cap, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        if not total or not weight:
            break
        rest = (total - at_cap) / weight
        if rest <= level:
            break
        level = rest
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target), n


def mix(docs: DataFrame, seed: int = 20) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3).

    The rate of a source is target / source_size. A document gets floor(rate) copies and one
    more if a number drawn from md5(seed, doc_id) is below the fraction, so reruns agree.
    Where rows of different source or text have one doc_id, or none, one of them draws so and
    the others from md5(seed, doc_id, mark): only rows equal in all three draw alike.
    A null text has size 0. A source of size 0 has target 0 and keeps one copy of its
    documents, which add no words. Columns of these names in the input are replaced.
    Sources are broadcast up to ``BROADCAST_SOURCES``.
    """
    return with_copies(docs.withColumns({"size": n_words(F.col("text")), MARK: mark()}), seed).drop(MARK)


def mark() -> Column:
    """A 64-bit hash that tells rows of one doc_id apart."""
    return F.xxhash64("source", F.isnull("source"), "text")


def sizes_of(docs: DataFrame) -> DataFrame:
    """One slim row per document, counted in one scan of the texts and written out."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mark().alias(MARK)), "mix-sizes")


def with_copies(sized: DataFrame, seed: int = 20, sizes: DataFrame | None = None) -> DataFrame:
    """As ``mix`` for rows that have a ``size`` and a ``MARK``; ``sizes`` may hold these columns of all rows already."""
    slim = sized if sizes is None else sizes
    targets, n = source_targets(slim.select("source", "size"))
    # Ids of several marks are few, or one of very many rows: the planner sees the size of their table.
    marks = slim.groupBy("doc_id").agg(F.min(MARK).alias("_mx_first"), F.max(MARK).alias("_mx_last"))
    shared = cut(marks.where("_mx_first <> _mx_last").select(F.col("doc_id").alias("_mx_id"), "_mx_first"), "mix-shared")
    facts = targets.select(F.col("source").alias("_mx_source"), "source_size", "target")
    rows = sized.drop("source_size", "target", "copies")
    facts = F.broadcast(facts) if n <= BROADCAST_SOURCES else facts
    joined = rows.join(facts, rows["source"].eqNullSafe(facts["_mx_source"]), "left").drop("_mx_source")
    joined = joined.join(shared, joined["doc_id"].eqNullSafe(shared["_mx_id"]), "left").drop("_mx_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    later = F.col("_mx_first") != F.col(MARK)
    key = F.when(later, F.concat(key, F.lit(":"), F.col(MARK).cast("string"))).otherwise(key)
    draw = F.conv(F.substring(F.md5(key), 1, _UNIT_DIGITS), 16, 10).cast("double") / F.lit(float(16**_UNIT_DIGITS))
    return (
        joined.withColumn("_mx_rate", rate)
        .withColumn("copies", (F.floor("_mx_rate") + F.when(draw < F.col("_mx_rate") - F.floor("_mx_rate"), 1).otherwise(0)).cast("int"))
        .drop("_mx_rate", "_mx_first")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents with no copy leave."""
    return mixed.withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_mx_copy")


def assignments(docs: DataFrame, seed: int = 20) -> DataFrame:
    """One slim row per document."""
    slim = sizes_of(docs)
    return with_copies(slim, seed).withColumn("taken", F.col("size") * F.col("copies")).drop(MARK)
