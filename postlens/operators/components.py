"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.materialize import cut
from postlens.operators.skew import HOT_ROWS, lookup


def connected_components(edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; root is the smallest vertex.

    Each round points every vertex at its smallest neighbour, follows that pointer once
    more, and contracts the edges along it. A vertex that is not a local minimum disappears,
    so the vertices at least halve and the rounds grow with the logarithm of the longest
    chain. The round's tables are written out; the loop ends when no edge is left. Every
    lookup weighs a key by the rows that meet it there: neighbours that share a pointer,
    vertices already merged into a root, edges of a vertex; keys of more than ``hot_rows``
    are salted, and none is looked for where all edges together are fewer.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    roots = both.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v"))
    left = edges.count()
    most = 2 * left  # vertices at most, now and in every later round
    while left:
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        parent = cut(nearest.select("v", F.least("v", "m").alias("p")), "parents")
        onward = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        if most > (HOT_ROWS if hot_rows is None else hot_rows):
            onward = onward.join(parent.groupBy("p").agg(F.count("*").alias("weight")), "p")
        else:
            onward = onward.withColumn("weight", F.lit(1))
        jump = cut(lookup(parent, onward, ["p"], "weight", "v", hot_rows, most).select("v", F.col("pp").alias("p")), "jumps")

        def follow(df: DataFrame, column: str, spread_by: str) -> DataFrame:
            facts = jump.withColumnRenamed("v", column).withColumn("weight", F.lit(1))
            if most > (HOT_ROWS if hot_rows is None else hot_rows):
                weights = df.groupBy(column).agg(F.count("*").alias("weight"))
                facts = facts.drop("weight").join(cut(weights, "weights"), column)
            moved = lookup(df, facts, [column], "weight", spread_by, hot_rows, most)
            return moved.withColumn(column, F.coalesce("p", column)).drop("p")

        roots = cut(follow(roots, "root", "v").select("v", "root"), "roots")
        moved = follow(follow(edges, "a", "b"), "b", "a")
        edges = cut(moved.where("a <> b").select("a", "b").distinct(), "edges")
        left = edges.count()
    return roots
