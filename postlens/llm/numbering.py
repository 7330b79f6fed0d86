"""Gapless global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.materialize import cut

_POSITION_BITS = 33  # monotonically_increasing_id() keeps the position in its low 33 bits


def number_rows(df: DataFrame, order: list[Column], name: str, row_no: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_no`` counting from 0 in the given order, and the number of rows.

    Rows are range-partitioned and sorted once and written out, so that a lost executor
    cannot move a boundary between counting and numbering. A partition's first number is the
    count of all rows before it: one row per partition is summed and broadcast. Rows that
    tie in every key are told apart by their place in the input, so a group of equal rows
    of any size is split over partitions. An input column called ``row_no`` is replaced.
    """
    tied = df.withColumn("_nr_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, F.col("_nr_tie")).sortWithinPartitions(*order, F.col("_nr_tie"))
    mid = F.col("_nr_mid")
    placed = cut(
        ranged.drop("_nr_tie")
        .withColumn("_nr_mid", F.monotonically_increasing_id())
        .withColumn("_nr_part", F.shiftright(mid, _POSITION_BITS))
        .withColumn("_nr_pos", mid.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_nr_mid"),
        name,
    )
    counts = {r["_nr_part"]: r["n"] for r in placed.groupBy("_nr_part").agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for part in sorted(counts):  # one entry per partition, whatever the number of rows
        first.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(first, "_nr_part long, _nr_first long")
    numbered = placed.join(F.broadcast(offsets), "_nr_part").withColumn(row_no, F.col("_nr_first") + F.col("_nr_pos"))
    return numbered.drop("_nr_part", "_nr_pos", "_nr_first"), total
