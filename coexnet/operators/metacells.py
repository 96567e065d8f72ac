"""Nearest-neighbour metacells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.features import log_normalize
from coexnet.operators.rounds import keep


BLOCK_CELLS = 2048


def knn_within_group(coords: DataFrame, k: int, block_cells: int = BLOCK_CELLS, asking: DataFrame | None = None) -> DataFrame:
    """(group, cell, neighbour, d2, rank): the k nearest other cells of the same group, from (group, cell, coords), for all cells or those of ``asking`` (group, cell).

    A group is dealt into blocks of about ``block_cells``; two blocks meet in a task, which keeps
    k neighbours of each cell, so a large group is spread over many tasks and no pairs are emitted.
    """
    cell_type = coords.schema["cell"].dataType.simpleString()
    blocks = coords.groupBy("group").agg(F.ceil(F.count("*") / block_cells).cast("int").alias("blocks"))
    x = coords.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = (x if asking is None else x.join(asking, ["group", "cell"], "left_semi")).select("group", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("ask"), "cell", "coords")
    gives = x.select("group", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("ask"), "cell", "coords")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["ask"].to_numpy(bool)
        at = np.stack(pdf["coords"].to_numpy()).astype(float)
        a, b, ids = at[ask], at[~ask], pdf["cell"].to_numpy()
        mine, others = ids[ask], ids[~ask]
        out = []
        order = np.argsort(others, kind="stable")
        b, others = b[order], others[order]
        for lo in range(0, len(a), 256):
            d = np.zeros((len(a[lo : lo + 256]), len(b)))
            for c in range(a.shape[1]):
                d += (a[lo : lo + 256, c][:, None] - b[None, :, c]) ** 2
            d = np.round(d, 9)
            d[mine[lo : lo + 256][:, None] == others[None, :]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(d, best, 1)
            row, at_ = np.nonzero(np.isfinite(far))
            out.append((mine[lo + row], others[best[row, at_]], far[row, at_]))
        cell, neighbour, d2 = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        name = lambda v: pd.Series(v, dtype=object)
        return pd.DataFrame({"group": name([pdf["group"].iloc[0]] * len(d2)), "cell": name(cell), "neighbour": name(neighbour), "d2": pd.Series(d2, dtype=float)})

    group_type = coords.schema["group"].dataType.simpleString()
    found = asks.unionAll(gives).groupBy("group", "i", "j").applyInPandas(near, f"`group` {group_type}, cell {cell_type}, neighbour {cell_type}, d2 double")
    w = Window.partitionBy("group", "cell").orderBy("d2", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, place) of the nodes that a walk in order of ``place`` takes, each unless it has an edge to one taken before.

    ``edges`` is (group, a, b) with a before b. In each round all nodes are taken whose earlier neighbours are decided,
    and the later neighbours of those fall out; for an order by hash the rounds grow with the logarithm of the nodes.
    """
    state = keep(nodes.select("group", "place", F.lit(0).alias("state")))  # 0 open, 1 taken, 2 out
    edges = keep(edges)
    while state.where("state = 0").head(1):
        free = state.where("state = 0").select("group", "place")
        waits = edges.join(free.withColumnRenamed("place", "a"), ["group", "a"], "left_semi").select("group", F.col("b").alias("place"))
        now = free.join(waits, ["group", "place"], "left_anti")
        out = edges.join(now.withColumnRenamed("place", "a"), ["group", "a"], "left_semi").select("group", F.col("b").alias("place"), F.lit(2).alias("new"))
        new = now.select("group", "place", F.lit(1).alias("new")).unionAll(out).groupBy("group", "place").agg(F.min("new").alias("new"))
        state = keep(state.join(new, ["group", "place"], "left").select("group", "place", F.when(F.col("state") == 0, F.coalesce("new", F.lit(0))).otherwise(F.col("state")).alias("state")))
    return state.where("state = 1").select("group", "place")


def metacell_members(coords: DataFrame, k: int = 25, max_shared: int = 15, target: int | None = 1000, max_iter: int = 5000, seed: str = "0") -> DataFrame:
    """(group, metacell, cell): greedily chosen neighbourhoods that share at most ``max_shared`` cells pairwise.

    Centres are visited in the order of a hash, ``max_iter`` at most, until a group has ``target`` of them. A group of at most ``k`` cells is
    one metacell. The choice is that of the walk but made in rounds over the table of centres that share too much, so no
    task sees a group.
    """
    sizes = coords.groupBy("group").agg(F.count_distinct("cell").alias("n"))
    first = Window.partitionBy("group").orderBy(F.md5(F.concat_ws("#", F.col("cell").cast("string"), F.lit(seed))), "cell")
    large = sizes.where(F.col("n") > k).select("group", F.lit(target).cast("long").alias("want") if target else F.floor(F.col("n") / k).alias("want"))
    centres = coords.select("group", "cell").distinct().join(large, "group").withColumn("place", F.row_number().over(first)).where(F.col("place") <= max_iter)
    centres = keep(centres)
    near = knn_within_group(coords, k - 1, asking=centres).select("group", "cell", "neighbour")
    hoods = near.unionAll(centres.select("group", "cell", F.col("cell").alias("neighbour"))).join(centres.select("group", "cell", "place"), ["group", "cell"])
    hoods = keep(hoods.select("group", "place", "neighbour"))
    both = hoods.select("group", "neighbour", F.col("place").alias("a")).join(hoods.select("group", "neighbour", F.col("place").alias("b")), ["group", "neighbour"]).where("a < b")
    edges = both.groupBy("group", "a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") > max_shared).select("group", "a", "b")
    order = Window.partitionBy("group").orderBy("place")
    taken = first_independent(centres, edges).withColumn("i", F.row_number().over(order)).join(large, "group").where(F.col("i") <= F.col("want"))
    more = taken.groupBy("group").agg(F.count("*").alias("chosen")).where("chosen > 1").select("group")
    name = lambda i: F.concat(F.col("group").cast("string"), F.lit("_"), i)
    found = taken.join(more, "group").join(hoods, ["group", "place"]).select("group", name(F.col("i").cast("string")).alias("metacell"), F.col("neighbour").alias("cell"))
    whole = coords.select("group", "cell").distinct().join(sizes.where(F.col("n") <= k).select("group"), "group").select("group", name(F.lit("1")).alias("metacell"), "cell")
    return found.unionAll(whole)


def aggregate_members(expr: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cell, gene, value): summed expression of each metacell's members over ``k``."""
    x = members.select("metacell", "cell").distinct().join(expr, "cell")
    return x.groupBy(F.col("metacell").alias("cell"), "gene").agg((F.sum("value") / k).alias("value"))


def metacells_by_groups(expr: DataFrame, cells: DataFrame, coords: DataFrame, by: list[str], k: int = 25, max_shared: int = 15, min_cells: int = 100, target: int | None = 1000, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(metacell expression, log-normalised; members) for the groups with at least ``min_cells`` cells."""
    if not by:
        raise ValueError("group columns are required")
    key = F.concat_ws("#", *(F.col(c).cast("string") for c in by))
    grouped = cells.select("cell", key.alias("group"))
    large = grouped.groupBy("group").count().where(F.col("count") >= min_cells).select("group")
    members = metacell_members(grouped.join(large, "group", "left_semi").join(coords.select("cell", "coords"), "cell"), k, max_shared, target, seed=seed)
    return log_normalize(aggregate_members(expr, members, k)), members
