"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Only DataFrame functions are used. The permutation is evaluated per row from the row number,
the number of rows and a seed, so a row's shard and slot can be computed without moving it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.numbering import number_rows

ROUNDS = 8


def halves(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square rectangle that holds ``n`` numbers."""
    left = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return left, max(1, -(-max(n, 1) // left))


def _div(x: Column, size: int) -> Column:
    return ((x - F.pmod(x, F.lit(size).cast("long"))) / F.lit(size)).cast("long")


def permute(x: Column, n: int, seed: int) -> Column:
    """Image of a number below left*right under the Feistel network."""
    left, right = halves(n)

    def turn(halves_now: Column, k: Column) -> Column:
        high, low = halves_now["high"], halves_now["low"]

        def mixed(half: Column, size: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(seed), k, half), F.lit(size).cast("long"))

        up = F.struct(F.pmod(high + mixed(low, left), F.lit(left).cast("long")).alias("high"), low.alias("low"))
        down = F.struct(high.alias("high"), F.pmod(low + mixed(high, right), F.lit(right).cast("long")).alias("low"))
        return F.when(k % 2 == 0, up).otherwise(down)

    whole = F.lit(right).cast("long")
    start = F.struct(_div(x, right).alias("high"), F.pmod(x, whole).alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: at["high"] * whole + at["low"])


def longest_walk(df: DataFrame, n: int, seed: int) -> int:
    """How many applications bring every number below ``n`` back below ``n``.

    The surplus numbers n .. left*right-1 are fewer than sqrt(n)+1. Those still outside
    after k steps shrink until only closed cycles of surplus numbers remain, which no number
    below ``n`` can enter; the step at which they stop shrinking bounds every walk.
    """
    left, right = halves(n)
    outside, steps = left * right - n, 1
    spark = df.sparkSession
    while outside:
        walked = spark.range(n, left * right)
        for _ in range(steps):
            walked = walked.where(F.col("id") >= n).select(permute(F.col("id"), n, seed).alias("id"))
        now = walked.where(F.col("id") >= n).count()
        if now == outside:
            break
        outside, steps = now, steps + 1
    return steps


def shard_rows(df: DataFrame, order: list[Column], n_shards: int, seed: int = 20) -> DataFrame:
    """``df`` with ``law`` = 'rows', ``shard`` (0 .. n_shards-1), ``slot`` and ``row_no``.

    Rows are numbered in ``order``, the number is permuted (walking on while it falls
    outside the table), and the image p gives shard p mod n_shards, slot p div n_shards.
    Shards differ by one row at most and slots are gapless from 0. Equal input and seed give
    the same result on any cluster, as far as ``order`` tells rows apart; equal rows may
    swap places. Nulls order first; empty input gives an empty result; input columns named
    like an output column are replaced.
    """
    numbered, n = number_rows(df, order, "shard-rows", "row_no")
    walks = longest_walk(df, n, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)),
        F.col("row_no"),
        lambda x, step: F.when((step == 1) | (x >= n), permute(x, n, seed)).otherwise(x),
    )
    placed = numbered.withColumn("_sh_p", walked)
    return (
        placed.withColumn("law", F.lit("rows"))
        .withColumn("shard", F.pmod("_sh_p", F.lit(n_shards)).cast("int"))
        .withColumn("slot", _div(F.col("_sh_p"), n_shards))
        .drop("_sh_p")
    )
