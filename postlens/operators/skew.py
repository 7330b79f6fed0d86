"""Joins and lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postlens.operators.materialize import cut

# A key is hot when it stands for more rows than this. At most rows/HOT_ROWS keys can be
# hot, so the table of hot keys stays far below the broadcast limit for any input.
HOT_ROWS = 1_000_000
SALTS = 64


def key_hash(*cols: Column) -> list[Column]:
    """128 bits of hash as two longs: narrow grouping keys for wide natural keys."""
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


def lookup(
    rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread_by: str, hot_rows: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Left join of many rows to one fact row per key, with hot keys salted.

    ``facts`` carries in ``weight`` how many rows share its key, which the aggregation that
    built it already knew. Facts of hot keys are copied to every salt and their rows are
    dealt over the salts by ``spread_by``; all other keys use salt 0. Where no weight can be
    over ``most`` and that makes no key hot, the join is a plain one.
    """
    threshold = HOT_ROWS if hot_rows is None else hot_rows
    if most is not None and most <= threshold:
        return rows.join(facts.drop(weight), keys, "left")
    # Safe to broadcast: the weights add up to the rows, so at most rows/threshold keys are hot.
    hot = facts.where(F.col(weight) > threshold).select(*keys, F.lit(True).alias("_hot"))
    salted_rows = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)),
        )
        .drop("_hot")
    )
    copies = F.when(F.col(weight) > threshold, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_facts = facts.withColumn("_salt", F.explode(copies)).drop(weight)
    return salted_rows.join(salted_facts, [*keys, "_salt"], "left").drop("_salt")


def number_copies(
    rows: DataFrame, keys: list[str], name: str, hot_rows: int | None = None, order: list[Column] | None = None
) -> DataFrame:
    """``rows`` with ``name`` counting from 0 the rows that are equal in ``keys``.

    Rows alone in their key are not moved. A key of more than ``hot_rows`` rows is dealt over
    salts, numbered there in ``order`` and moved up by the rows of the salts before; which
    number a row of such a key gets is otherwise open.
    """
    threshold = HOT_ROWS if hot_rows is None else hot_rows
    repeated = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), "copies-keys")
    if repeated.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    told = rows.join(repeated, keys, "left")
    alone = told.where("_n IS NULL").drop("_n").withColumn(name, F.lit(0).cast("long"))
    salt = F.when(F.col("_n") > threshold, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    # Written out, so that a lost executor cannot deal the rows anew.
    dealt = cut(told.where("_n IS NOT NULL").withColumn("_salt", salt.cast("int")).drop("_n"), "copies-dealt")
    held = dealt.groupBy(*keys, "_salt").agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    firsts = held.select(*keys, "_salt", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order or [F.lit(0)])) - 1
    counted = dealt.withColumn("_place", place).join(firsts, [*keys, "_salt"])
    numbered = counted.withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).drop("_salt", "_first", "_place")
    return alone.unionByName(numbered)
