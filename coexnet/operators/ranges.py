"""Running sums and least values over range partitions.

A group may hold most of a table, so no task has to see one whole: rows are dealt out by ranges of group and order, each range is summed
alone, and the ranges' totals (a row for each group and range) move the next ones up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.rounds import keep


def deal(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` written in ranges of ``by`` and ``order``; ``__part`` tells which."""
    return keep(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))


def running(dealt: DataFrame, by: list[str], order: str, value: str, out: str, least: bool = False, backwards: bool = False) -> DataFrame:
    """``dealt`` with the sum of ``value`` (or with ``least`` its smallest) over each group's rows up to each one in ``order``, or from it on.

    Rows are unique by ``by`` and ``order``.
    """
    fold, turn = (F.min if least else F.sum), (F.desc if backwards else F.asc)
    before = Window.partitionBy(*by).orderBy(turn("__part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part", *by).agg(fold(value).alias("__total"))
    offset = totals.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), fold("__total").over(before).alias("__offset"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    inside = fold(value).over(Window.partitionBy("__part", *by).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moved = F.least(inside, F.col("__offset")) if least else inside + F.coalesce("__offset", F.lit(0))
    return dealt.join(offset, same).withColumn(out, moved).drop("__p", "__offset", *(f"__{i}" for i in range(len(by))))


def tally(df: DataFrame, by: list[str], value: str, **sums) -> DataFrame:
    """One row for each group and distinct value: ``ties`` of them, ``upto`` rows of the group up to it, and the named sums."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties"), *(c.alias(k) for k, c in sums.items()))
    return running(deal(counts, by, value), by, value, "ties", "upto").drop("__part")


def mean_rank():
    """The rank that equal values share, from ``tally``."""
    return F.col("upto") - (F.col("ties") - 1) / 2.0
