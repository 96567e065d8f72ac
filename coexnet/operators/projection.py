"""Projection of modules onto other data, and their preservation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.modules import loadings, standardise, weighted_scores
from coexnet.operators.network import both_ways


def project(target: DataFrame, loads: DataFrame) -> DataFrame:
    """(cell, module, score): target values times loadings, joined by gene name."""
    return target.join(loads.select("gene", "module", "loading"), "gene").groupBy("cell", "module").agg(F.sum(F.col("value") * F.col("loading")).alias("score"))


def project_modules(source: DataFrame, target: DataFrame, modules: DataFrame, n_source: int, n_target: int, least_shared: int = 20, least_genes: int = 3, cells: DataFrame | None = None) -> DataFrame:
    """(cell, module, score): first components of the source's modules applied to the standardised target, for all its ``cells``.

    Both sides are centred and divided by the population deviation plus 1e-8; modules with under ``least_genes`` shared genes are left out.
    """
    shared = source.select("gene").distinct().join(target.select("gene").distinct(), "gene", "left_semi").join(modules.select("gene"), "gene", "left_semi")
    if shared.limit(least_shared).count() < least_shared:
        raise ValueError(f"fewer than {least_shared} shared genes")
    keep = lambda x: x.join(shared, "gene", "left_semi")
    how = {"clip": None, "ddof": 0, "floor": 0.0, "add": 1e-8}
    inside = keep(modules)
    large = inside.groupBy("module").count().where(F.col("count") >= least_genes).select("module")
    loads = loadings(*standardise(keep(source), n_source, **how), inside.join(large, "module", "left_semi"), n_source)
    return weighted_scores(*standardise(keep(target), n_target, **how), loads, target.select("cell").distinct() if cells is None else cells, "score")


def module_density(tom: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, n_genes, observed): summed overlap within each module, both directions."""
    m = modules.where("module <> 'grey'").select("gene", "module")
    inner = tom.join(m.select(F.col("gene").alias("g1"), "module"), "g1").join(m.select(F.col("gene").alias("g2"), F.col("module").alias("other")), "g2").where("module = other")
    size = modules.where("module <> 'grey'").groupBy("module").agg(F.count("*").alias("n_genes"))
    s = inner.groupBy("module").agg((2 * F.sum("tom")).alias("observed"))
    return size.join(s, "module", "left").select("module", "n_genes", F.coalesce("observed", F.lit(0.0)).alias("observed"))


LEVELS = ((10.0, "highly preserved"), (5.0, "moderately preserved"), (2.0, "weakly preserved"))


def median_overlap(tom: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, median_rank): median over a module's genes of their median overlap with its genes, themselves included with 1."""
    m = modules.where("module <> 'grey'").select("gene", "module")
    inner = both_ways(tom, "tom").join(m.select(F.col("gene").alias("i"), "module"), "i").join(m.select(F.col("gene").alias("j"), "module"), ["j", "module"]).select("module", "i", "tom")
    own = m.select("module", F.col("gene").alias("i"), F.lit(1.0).alias("tom"))
    return inner.unionAll(own).groupBy("module", "i").agg(F.median("tom").alias("m")).groupBy("module").agg(F.median("m").alias("median_rank"))


def preservation(tom: DataFrame, modules: DataFrame, n_permutations: int = 100, seed: str = "42", least: int = 5, least_genes: int = 50) -> DataFrame:
    """(module, n_genes, observed, mean, sd, z_summary, median_rank, preservation) against random gene sets of the same size.

    Pass the overlap of the reference, or that of a test set to ask whether it holds there; fewer than ``least_genes`` genes are an error.
    The sets are the first genes in the order of a hash of permutation, module and gene. Modules of under ``least`` genes have no figures.
    """
    genes = modules.select("gene").distinct()
    if genes.limit(least_genes).count() < least_genes:
        raise ValueError(f"fewer than {least_genes} common genes")
    obs = module_density(tom, modules)
    big = obs.where(F.col("n_genes") >= least)
    draws = genes.join(F.broadcast(big.select("module", "n_genes")), F.lit(True), "cross").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))  # what is drawn from
    order = Window.partitionBy("module", "draw").orderBy(F.md5(F.concat_ws("#", F.lit(seed), "draw", "module", "gene")), "gene")
    sets = draws.withColumn("r", F.row_number().over(order)).where("r <= n_genes").select("module", "draw", "gene")
    inner = tom.join(sets.withColumnRenamed("gene", "g1"), "g1").join(sets.select("module", "draw", F.col("gene").alias("g2")), ["module", "draw", "g2"])
    null = inner.groupBy("module", "draw").agg((2 * F.sum("tom")).alias("s")).groupBy("module").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))
    z = F.when(F.col("n_genes") >= least, F.coalesce((F.col("observed") - F.col("mean")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0)))
    level = F.when(F.col("n_genes") < least, "error")
    for at, name in LEVELS:
        level = level.when(F.col("z_summary") >= at, name)
    x = obs.join(null, "module", "left").join(median_overlap(tom, modules), "module", "left").withColumn("z_summary", z)
    return x.withColumns({"median_rank": F.when(F.col("n_genes") >= least, F.col("median_rank")), "preservation": level.otherwise("non-preserved")})
