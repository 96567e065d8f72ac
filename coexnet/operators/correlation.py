"""All-pairs correlation of genes over cells.

Two physical plans give the same sums of products. ``relational`` joins the
matrix to itself by cell. ``blocked`` cuts genes into blocks and cells into chunks; a task
owns a tile (two blocks), adds up the matrix products of its chunks one after the other and emits each
pair once. Few tiles are cut by cells as well, and their sums added. A value is sent once for each
block of genes, and no group holds more than a chunk of two blocks.
Moments count absent values as zeros, and pairs that never meet are in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coexnet.operators import ranges
from coexnet.operators.rounds import keep

CHUNK_CELLS = 4096
BLOCK_GENES = 512
LEAST_TASKS = 64
MOST_TASKS = 4096


def _products_relational(expr: DataFrame) -> DataFrame:
    a = expr.select("cell", F.col("gene").alias("g1"), F.col("value").alias("v1"))
    b = expr.select("cell", F.col("gene").alias("g2"), F.col("value").alias("v2"))
    return a.join(b, "cell").where("g1 < g2").groupBy("g1", "g2").agg(F.sum(F.col("v1") * F.col("v2")).alias("sxy"))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of equal keys of sorted rows, also across batches."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        for key, rows in pdf.groupby(keys, sort=True):
            if held and key != last:
                yield last, pd.concat(held)
                held = []
            held.append(rows)
            last = key
    if held:
        yield last, pd.concat(held)


def _multiply_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of two blocks of genes; one chunk of cells and one tile of sums are held at a time."""
    names: list[np.ndarray] = []
    total = np.zeros((0, 0))

    def grown(old: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        new = np.union1d(old, np.unique(rows["gene"].to_numpy().astype(str)))
        return new, np.searchsorted(new, old)

    def finish(tile: tuple) -> pd.DataFrame:
        (left, right), same = names, tile[0] == tile[1]
        i, j = np.triu_indices(len(left), 1) if same else (np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left)))
        a, b = left[i], right[j]
        swap = a > b
        return pd.DataFrame({"g1": np.where(swap, b, a), "g2": np.where(swap, a, b), "sxy": total[i, j]})

    tile = None
    for key, rows in _runs(batches, ["bi", "bj", "part", "chunk"]):
        if key[:3] != tile:
            if tile is not None:
                yield finish(tile)
            tile, names, total = key[:3], [np.array([], str)] * 2, np.zeros((0, 0))
        sides = [rows[rows["b"] == tile[0]], rows[rows["b"] == tile[1]]]
        (left, at_left), (right, at_right) = (grown(old, side) for old, side in zip(names, sides, strict=True))
        bigger = np.zeros((len(left), len(right)))
        bigger[np.ix_(at_left, at_right)] = total
        both = pd.unique(rows["cell"])
        if len(both):
            everywhere = rows.assign(cell=pd.Categorical(rows["cell"], categories=both).codes)
            x, y = np.zeros((len(left), len(both))), np.zeros((len(right), len(both)))
            for out, genes, block in ((x, left, tile[0]), (y, right, tile[1])):
                own = everywhere[everywhere["b"] == block]
                np.add.at(out, (np.searchsorted(genes, own["gene"].to_numpy().astype(str)), own["cell"].to_numpy()), own["value"].to_numpy(float))
            bigger += x @ y.T
        names, total = [left, right], bigger
    if tile is not None:
        yield finish(tile)


def _products_blocked(expr: DataFrame, chunk_cells: int, block_genes: int = BLOCK_GENES) -> DataFrame:
    size = expr.agg(F.count_distinct("cell").alias("cells"), F.count_distinct("gene").alias("genes")).first()
    chunks, blocks = max(1, -(-size["cells"] // chunk_cells)), max(1, -(-size["genes"] // block_genes))
    tiles = blocks * (blocks + 1) // 2
    parts = min(chunks, -(-LEAST_TASKS // tiles))  # few tiles are also cut by cells
    place = expr.select("cell", "gene", "value", F.pmod(F.xxhash64("cell"), F.lit(chunks)).cast("int").alias("chunk"), F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("b"))
    met = place.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("cell", "gene", "value", "chunk", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("chunk") % parts).alias("part"))
    dealt = met.repartition(min(tiles * parts, MOST_TASKS), "bi", "bj", "part").sortWithinPartitions("bi", "bj", "part", "chunk")
    sums = dealt.mapInPandas(_multiply_tiles, "g1 string, g2 string, sxy double")
    return sums if parts == 1 else sums.groupBy("g1", "g2").agg(F.sum("sxy").alias("sxy"))


def pair_products(expr: DataFrame, plan: str = "relational", chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """(g1, g2, sxy) for all g1 < g2 that share a cell."""
    if plan not in ("relational", "blocked"):
        raise ValueError(f"unknown plan {plan!r}")
    return _products_relational(expr) if plan == "relational" else _products_blocked(expr, chunk_cells)


def impute_means(expr: DataFrame, n_cells: int) -> DataFrame:
    """NaN values replaced by the mean of the gene's other values, absent zeros among them; a gene with nothing else gets 0."""
    m = expr.groupBy("gene").agg((F.sum(F.when(~F.isnan("value"), F.col("value"))) / F.nullif(F.lit(n_cells) - F.count_if(F.isnan("value")), F.lit(0))).alias("__mean"))
    return expr.join(m, "gene").select("cell", "gene", F.when(F.isnan("value"), F.coalesce("__mean", F.lit(0.0))).otherwise(F.col("value")).alias("value"))


def gene_grid(genes: DataFrame) -> DataFrame:
    """(g1, g2) for all g1 < g2: the size of the result, not of the data."""
    a, b = genes.select(F.col("gene").alias("g1")), genes.select(F.col("gene").alias("g2"))
    return a.join(b, F.col("g1") < F.col("g2"))


def pearson(expr: DataFrame, n_cells: int, plan: str = "relational", chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """(g1, g2, cor) for all g1 < g2; 0 where a gene is constant; clipped to [-1, 1]."""
    if plan == "blocked":
        expr = keep(expr.select("cell", "gene", "value"))  # read for its size, moments and products
    n = F.lit(float(n_cells))
    m = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    m = m.select("gene", "s", (n * F.col("ss") - F.col("s") * F.col("s")).alias("d"))
    a = m.select(F.col("gene").alias("g1"), F.col("s").alias("s1"), F.col("d").alias("d1"))
    b = m.select(F.col("gene").alias("g2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
    grid = a.join(b, F.col("g1") < F.col("g2"))
    both = grid.join(pair_products(expr, plan, chunk_cells), ["g1", "g2"], "left")
    cor = (n * F.coalesce("sxy", F.lit(0.0)) - F.col("s1") * F.col("s2")) / F.nullif(F.sqrt(F.greatest(F.col("d1") * F.col("d2"), F.lit(0.0))), F.lit(0.0))
    return both.select("g1", "g2", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(cor, F.lit(0.0)))).alias("cor"))


def rank_values(expr: DataFrame, n_cells: int) -> DataFrame:
    """The matrix with average ranks per gene, less the rank of its zeros: still sparse, and Pearson on it is Spearman.

    Ranks come from counts of each gene's distinct values, in ranges, so that no task holds a gene.
    """
    x = keep(expr.where("value <> 0").select("cell", "gene", "value"))
    counts = ranges.tally(x, ["gene"], "value")
    of = counts.groupBy("gene").agg((F.lit(n_cells) - F.sum("ties")).alias("zeros"), F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("ties"))), F.lit(0)).alias("negative"))
    full = ranges.mean_rank() + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0)
    ranked = counts.join(of, "gene").select("gene", F.col("value").alias("__v"), (full - F.col("negative") - (F.col("zeros") + 1) / 2.0).alias("rank"))
    return x.withColumnRenamed("value", "__v").join(ranked, ["gene", "__v"]).select("cell", "gene", F.col("rank").alias("value"))


def spearman(expr: DataFrame, n_cells: int, plan: str = "relational") -> DataFrame:
    return pearson(rank_values(expr, n_cells), n_cells, plan)


def densify(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """The matrix with its zeros, for statistics that need order within a gene."""
    grid = cells.select("cell").join(genes.select("gene"), F.lit(True), "cross")
    return grid.join(expr, ["cell", "gene"], "left").select("cell", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def column_medians(counts: DataFrame, n_cells: int, value: str, out: str) -> DataFrame:
    """(gene, out): the median of each gene's ``n_cells`` values, from (gene, value, ties)."""
    total = ranges.running(ranges.deal(counts, ["gene"], value), ["gene"], value, "ties", "upto")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(value)))
    return total.groupBy("gene").agg(((at((n_cells + 1) // 2) + at(n_cells // 2 + 1)) / 2.0).alias(out))


def biweight(expr: DataFrame, n_cells: int) -> tuple[DataFrame, DataFrame]:
    """(cell, gene, value) and (gene, base, total): unit-length biweight scores of each gene, without making zeros explicit.

    An absent value scores ``base``, a present one ``value + base``; ``total`` is the sum of the values. Medians and deviations come
    from counts of each gene's distinct values and of its zeros.
    """
    expr = keep(expr.select("cell", "gene", "value"))
    x = expr.where("value <> 0 and not isnan(value)")
    every = expr.select("gene").distinct()
    counts = x.groupBy("gene", "value").agg(F.count("*").alias("ties"))
    zeros = every.join(counts.groupBy("gene").agg(F.sum("ties").alias("n")), "gene", "left").select("gene", F.lit(0.0).alias("value"), (F.lit(n_cells) - F.coalesce("n", F.lit(0))).alias("ties"))
    counts = keep(counts.unionAll(zeros.where("ties > 0")))  # a row for each gene and distinct value
    away = counts.join(column_medians(counts, n_cells, "value", "med"), "gene").withColumn("away", F.abs(F.col("value") - F.col("med")))
    mad = column_medians(away.groupBy("gene", "away").agg(F.sum("ties").alias("ties")), n_cells, "away", "mad")
    c = F.col("value") - F.col("med")
    u = c / (9 * F.when(F.col("mad") < 1e-15, 1.0).otherwise(F.col("mad")))
    scored = keep(away.join(mad, "gene").withColumn("z", F.when(F.abs(u) < 1, c * (1 - u * u) * (1 - u * u)).otherwise(0.0)).select("gene", "value", "ties", "z"))
    length = F.sqrt(F.sum(F.col("ties") * F.col("z") * F.col("z")))
    norm = scored.groupBy("gene").agg(F.when(length < 1e-15, 1.0).otherwise(length).alias("norm"), F.coalesce(F.max(F.when(F.col("value") == 0, F.col("z"))), F.lit(0.0)).alias("z0"))
    scored = scored.where("value <> 0").join(norm, "gene").withColumn("s", (F.col("z") - F.col("z0")) / F.col("norm"))
    total = scored.groupBy("gene").agg(F.sum(F.col("s") * F.col("ties")).alias("total"))
    base = norm.join(total, "gene", "left").select("gene", (F.col("z0") / F.col("norm")).alias("base"), F.coalesce("total", F.lit(0.0)).alias("total"))
    values = x.withColumnRenamed("value", "__v").join(scored.select("gene", F.col("value").alias("__v"), "s"), ["gene", "__v"])
    return values.select("cell", "gene", F.col("s").alias("value")), keep(base)


def bicor(expr: DataFrame, n_cells: int, plan: str = "relational") -> DataFrame:
    """(g1, g2, cor): biweight midcorrelation, absent values being zeros; 0 where a gene's scores vanish.

    The product of two genes is that of their sparse scores and rank-one terms of their bases.
    """
    z, base = biweight(expr, n_cells)
    a, b = (base.select(F.col("gene").alias(f"g{i}"), F.col("base").alias(f"b{i}"), F.col("total").alias(f"s{i}")) for i in (1, 2))
    out = a.join(b, F.col("g1") < F.col("g2")).join(pair_products(z, plan), ["g1", "g2"], "left")
    r = F.coalesce("sxy", F.lit(0.0)) + F.col("b1") * F.col("s2") + F.col("b2") * F.col("s1") + n_cells * F.col("b1") * F.col("b2")
    return out.select("g1", "g2", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("cor"))


def correlate(expr: DataFrame, n_cells: int, method: str = "pearson", plan: str = "relational") -> DataFrame:
    """(g1, g2, cor) by one of the methods, after ``impute_means``."""
    expr = impute_means(expr, n_cells)
    if method == "pearson":
        return pearson(expr, n_cells, plan)
    if method == "spearman":
        return spearman(expr, n_cells, plan)
    if method == "bicor":
        return bicor(expr, n_cells, plan)
    raise ValueError(f"unknown method {method!r}")
