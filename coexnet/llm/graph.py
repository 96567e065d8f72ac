"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coexnet.llm.common import attach, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours (large star), then its smaller ones (small star), to the
    smallest node it knows. Rows never exceed the edges by more than the
    nodes, and rounds grow with the logarithm of the component size. Each
    round is written to the shared folder, so lost executors repeat one round
    at most. A node with very many neighbours, as the middle of a star, has them
    spread over tasks. Loops and null ends are dropped; an empty table gives no rows.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = attach(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach(large, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = save(small.where("u <> v").distinct(), "cc")
        new = mark(now)
        if new == seen:
            break
        seen = new
    stars = now.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionAll(stars.select("root").distinct().select(F.col("root").alias("node"), "root"))
