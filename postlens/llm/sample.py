"""Folds by a checksum of the id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


_DRAWS = 1 << 40


def lowest(keys: DataFrame, n: int, seed: int, by: str) -> DataFrame:
    """Distinct rows of ``keys``, those ``n`` of each value of ``by`` whose doc_id hashes lowest.

    Rows that can't be among them, for their hash and the number of rows of the value, go
    before anything is shuffled; where ids repeat very often that may leave fewer than ``n``.
    """
    drawn = keys.withColumn("_draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_DRAWS)))
    most = keys.groupBy(by).agg((F.lit(4.0 * n) / F.count("*") * _DRAWS).alias("_most"))
    likely = drawn.join(most, by).where("_draw <= _most").drop("_most").distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_draw", "doc_id"))
    return likely.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_draw")


def bounded(docs: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """``chosen`` with ``text``: one row of ``docs`` for each of its rows, whose keys ``on`` are distinct.

    Of rows with the same keys the text with the smallest hash is taken; each task keeps one.
    """
    text = F.min_by("text", F.xxhash64("text"))
    one = docs.select(*on, "text").join(chosen, on).groupBy(*chosen.columns).agg(text.alias("text"))
    return one
