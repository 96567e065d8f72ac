"""Module eigengenes, connectivity, hubs, reassignment and renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators import spectra
from coexnet.operators.correlation import biweight, pair_products
from coexnet.operators.rounds import keep

CLIP = 10.0


def module_order(module):
    """Natural order of names like M2, M10."""
    return F.coalesce(F.regexp_extract(module, r"(\d+)", 1).try_cast("int"), F.lit(1 << 30))


def scale_moments(expr: DataFrame, n_cells: int, ddof: int = 1, floor: float = 1e-8, add: float = 0.0) -> DataFrame:
    """(gene, mean, sd) over all cells, absent values being zeros; a deviation below ``floor`` counts as 1, ``add`` is added to it."""
    n = F.lit(float(n_cells))
    m = expr.groupBy("gene").agg((F.sum("value") / n).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    sd = F.sqrt(F.greatest((F.col("ss") - n * F.col("mean") * F.col("mean")) / (n - ddof), F.lit(0.0)))
    return m.select("gene", "mean", (F.when(sd < floor, 1.0).otherwise(sd) + add).alias("sd"))


def standardise(expr: DataFrame, n_cells: int, clip: float | None = CLIP, **how) -> tuple[DataFrame, DataFrame]:
    """(cell, gene, value) and (gene, zero): z-scores less the z-score of a zero, so that absent values stay absent, and that score.

    A sum of z-scores over genes is then the sum of the values there are, plus the sum of ``zero``.
    """
    m = scale_moments(expr, n_cells, **how)
    bound = lambda z: z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    m = m.select("gene", "mean", "sd", bound(-F.col("mean") / F.col("sd")).alias("zero"))
    z = bound((F.col("value") - F.col("mean")) / F.col("sd")) - F.col("zero")
    return expr.join(m, "gene").select("cell", "gene", z.alias("value")), m.select("gene", "zero")


def loadings(z: DataFrame, zeros: DataFrame, modules: DataFrame, n_cells: int, n_components: int = 1) -> DataFrame:
    """(module, gene, loading): first right singular vector of each module's z-scores; with more components, their numbers follow the module's name.

    By passes over the sparse matrix (``spectra``): no task holds the square of a module's genes.
    """
    found = spectra.leading(z, zeros, modules.where("module <> 'grey'"), n_cells, n_components)
    name = F.col("module") if n_components == 1 else F.concat("module", F.lit("\u0001"), F.lpad(F.col("component").cast("string"), 3, "0"))
    return found.select(name.alias("module"), "gene", "loading")


def weighted_scores(z: DataFrame, zeros: DataFrame, loads: DataFrame, cells: DataFrame, name: str = "me") -> DataFrame:
    """(cell, module, score): loadings times z-scores, summed for every cell, also for those without a value."""
    rest = loads.join(zeros, "gene").groupBy("module").agg(F.sum(F.col("zero") * F.col("loading")).alias("rest"))
    some = z.join(loads.select("gene", "module", "loading"), "gene").groupBy("cell", "module").agg(F.sum(F.col("value") * F.col("loading")).alias("s"))
    grid = cells.select("cell").crossJoin(F.broadcast(rest))  # the rows of the result; a row for each module
    return grid.join(some, ["cell", "module"], "left").select("cell", "module", (F.coalesce("s", F.lit(0.0)) + F.col("rest")).alias(name))


def eigengenes(expr: DataFrame, modules: DataFrame, n_cells: int, clip: float | None = CLIP, cells: DataFrame | None = None) -> DataFrame:
    """(cell, module, me): scores on the first component of each module, with the sign of its mean expression, for all ``cells`` (those in ``expr`` if not given)."""
    expr = keep(expr.select("cell", "gene", "value"))
    cells = expr.select("cell").distinct() if cells is None else cells
    z, zeros = standardise(expr, n_cells, clip)
    me = weighted_scores(z, zeros, loadings(z, zeros, modules, n_cells), cells)
    both = me.join(mean_expression(expr, modules).withColumnRenamed("me", "mean"), ["cell", "module"], "left")
    sign = both.groupBy("module").agg(F.when(F.covar_samp("me", F.coalesce("mean", F.lit(0.0))) < 0, -1.0).otherwise(1.0).alias("sign"))
    return me.join(sign, "module").select("cell", "module", (F.col("me") * F.col("sign")).alias("me"))


def component_scores(expr: DataFrame, modules: DataFrame, n_cells: int, n_components: int = 30, clip: float | None = CLIP, cells: DataFrame | None = None) -> DataFrame:
    """(cell, module, z): scores on a module's first components (as many as it has genes, ``n_components`` at most), the first with the sign of its eigengene."""
    expr = keep(expr.select("cell", "gene", "value"))
    cells = expr.select("cell").distinct() if cells is None else cells
    z, zeros = standardise(expr, n_cells, clip)
    # one more than wanted keeps the components' numbers in the names, also where one is wanted
    x = weighted_scores(z, zeros, loadings(z, zeros, modules, n_cells, n_components + 1), cells)
    parts = F.split("module", "\u0001")
    x = x.select("cell", parts[0].alias("module"), parts[1].cast("int").alias("i"), "me").where(F.col("i") < n_components)
    both = x.where("i = 0").join(mean_expression(expr, modules).withColumnRenamed("me", "mean"), ["cell", "module"], "left")
    sign = both.groupBy("module").agg(F.when(F.covar_samp("me", F.coalesce("mean", F.lit(0.0))) < 0, -1.0).otherwise(1.0).alias("sign"))
    x = x.join(sign, "module").groupBy("cell", "module").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("me") * F.col("sign")).alias("v")))).alias("x"))
    return x.select("cell", "module", F.transform("x", lambda e: e["v"]).alias("z"))


def harmonize(mes: DataFrame, cells: DataFrame, batch: list[str]) -> DataFrame:
    """(cell, module, me): batch means moved to the overall mean of each module.

    The linear part of a batch correction alone; ``harmony.harmony`` clusters softly in rounds.
    """
    x = mes.join(cells.select("cell", *batch), "cell")
    by_batch, by_module = Window.partitionBy("module", *batch), Window.partitionBy("module")
    return x.select("cell", "module", (F.col("me") - F.avg("me").over(by_batch) + F.avg("me").over(by_module)).alias("me"))


def mean_expression(expr: DataFrame, modules: DataFrame) -> DataFrame:
    """(cell, module, me): mean expression of a module's genes, zeros included."""
    size = modules.groupBy("module").agg(F.count("*").alias("size"))
    x = expr.join(F.broadcast(modules.select("gene", "module")), "gene").groupBy("cell", "module").agg(F.sum("value").alias("s"))
    return x.join(size, "module").select("cell", "module", (F.col("s") / F.col("size")).alias("me"))


def kme(expr: DataFrame, mes: DataFrame, n_cells: int) -> DataFrame:
    """(gene, module, kme): Pearson of every gene with every module's score, by moments; 0 where one is constant.

    ``mes`` has a row for every cell; absent expression is zero.
    """
    n = F.lit(float(n_cells))
    g = expr.groupBy("gene").agg(F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))
    m = mes.groupBy("module").agg(F.sum("me").alias("sy"), F.sum(F.col("me") * F.col("me")).alias("syy"))
    xy = expr.join(mes, "cell").groupBy("gene", "module").agg(F.sum(F.col("value") * F.col("me")).alias("sxy"))
    x = xy.join(g, "gene").join(m, "module")
    d = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(F.greatest(d, F.lit(0.0))), F.lit(0.0))
    return x.select("gene", "module", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))).alias("kme"))


def kme_bicor(expr: DataFrame, mes: DataFrame, n_cells: int) -> DataFrame:
    """(gene, module, kme): biweight midcorrelation of every gene with every module's score; absent values and NaN count as zero."""
    x, bx = biweight(expr, n_cells)
    y, by = biweight(mes.select("cell", F.col("module").alias("gene"), F.col("me").alias("value")), n_cells)
    xy = x.join(y.select("cell", F.col("gene").alias("module"), F.col("value").alias("y")), "cell").groupBy("gene", "module").agg(F.sum(F.col("value") * F.col("y")).alias("xy"))
    both = bx.join(by.select(F.col("gene").alias("module"), F.col("base").alias("base_y"), F.col("total").alias("total_y")), F.lit(True))  # the result's rows
    r = F.coalesce("xy", F.lit(0.0)) + F.col("base") * F.col("total_y") + F.col("base_y") * F.col("total") + n_cells * F.col("base") * F.col("base_y")
    return both.join(xy, ["gene", "module"], "left").select("gene", "module", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("kme"))


def hub_genes(modules: DataFrame, kmes: DataFrame, n_hubs: int = 10) -> DataFrame:
    """(module, gene, kme, rank): the top genes of each module by their own module's connectivity."""
    own = modules.where("module <> 'grey'").select("gene", "module").join(kmes, ["gene", "module"])
    w = Window.partitionBy("module").orderBy(F.desc(F.round("kme", 9)), "gene")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_hubs).select("module", "gene", "kme", "rank")


def reassign_negative(modules: DataFrame, kmes: DataFrame) -> DataFrame:
    """(gene, module, new_module): genes with negative own connectivity move to their best module, or to grey if that is negative."""
    best = kmes.groupBy("gene").agg(F.max(F.struct(F.round("kme", 9).alias("k"), F.col("module"))).alias("b"))
    own = kmes.select("gene", "module", F.col("kme").alias("own"))
    x = modules.select("gene", "module").join(own, ["gene", "module"], "left").join(best, "gene", "left")
    moved = F.when(F.col("b.k") < 0, "grey").otherwise(F.coalesce("b.module", F.lit("grey")))
    return x.select("gene", "module", F.when(F.round("own", 9) < 0, moved).otherwise(F.col("module")).alias("new_module"))


def reassign_manual(modules: DataFrame, genes: dict[str, str], ignore: bool = False) -> DataFrame:
    """``modules`` with some genes moved by hand; only grey genes may move unless ``ignore``."""
    new = modules.sparkSession.createDataFrame(list(genes.items()), "gene string, new_module string")
    x = modules.join(F.broadcast(new), "gene", "left")
    if not ignore and x.where("new_module is not null and module <> 'grey'").limit(1).count():
        raise ValueError("a gene to move is in a module; pass ignore=True to move it anyway")
    return x.select("gene", F.coalesce("new_module", "module").alias("module"))


def first_appearance(modules: DataFrame, places: DataFrame) -> DataFrame:
    """(module, first, ord): modules in the order in which they appear among genes, from (gene, place)."""
    first = modules.join(places, "gene").groupBy("module").agg(F.min("place").alias("first"))
    return first.withColumn("ord", F.row_number().over(Window.orderBy("first")))  # a row for each module


def rename_modules(modules: DataFrame, prefix: str = "M") -> DataFrame:
    """(gene, module, new_module): names numbered anew in natural order; grey stays."""
    names = modules.where("module <> 'grey'").select("module").distinct()
    names = names.select("module", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(module_order(F.col("module")), "module")).cast("string")).alias("new_module"))
    return modules.select("gene", "module").join(F.broadcast(names), "module", "left").select("gene", "module", F.coalesce("new_module", "module").alias("new_module"))


def module_correlation(mes: DataFrame) -> DataFrame:
    """(m1, m2, cor) of module scores for m1 < m2."""
    x = mes.select("cell", F.col("module").alias("gene"), F.col("me").alias("value"))
    n = F.col("n").cast("double")
    m = x.groupBy("gene").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    p = pair_products(x).join(F.broadcast(m.select(F.col("gene").alias("g1"), "n", F.col("s").alias("s1"), F.col("ss").alias("q1"))), "g1").join(F.broadcast(m.select(F.col("gene").alias("g2"), F.col("s").alias("s2"), F.col("ss").alias("q2"))), "g2")
    d = (n * F.col("q1") - F.col("s1") * F.col("s1")) * (n * F.col("q2") - F.col("s2") * F.col("s2"))
    return p.select(F.col("g1").alias("m1"), F.col("g2").alias("m2"), F.coalesce((n * F.col("sxy") - F.col("s1") * F.col("s2")) / F.nullif(F.sqrt(F.greatest(d, F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("cor"))
