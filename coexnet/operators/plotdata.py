"""The tables behind the plots, and agreement of two module assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.modules import hub_genes
from coexnet.operators.network import both_ways


def dot_data(mes: DataFrame, cells: DataFrame, by: str, limit: float = 2.5) -> DataFrame:
    """(group, module, mean, frac, z): group means of scores, share above zero, and the mean's z-score over groups, clipped."""
    g = mes.join(cells.select("cell", F.col(by).cast("string").alias("group")), "cell").groupBy("group", "module").agg(F.avg("me").alias("mean"), F.avg((F.col("me") > 0).cast("double")).alias("frac"))
    w = Window.partitionBy("module")
    sd = F.stddev_samp("mean").over(w)
    z = F.when(sd > 0, (F.col("mean") - F.avg("mean").over(w)) / sd).otherwise(0.0)
    return g.withColumn("z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def radar_data(mes: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """(group, module, value): group means of scores, not below zero."""
    g = mes.join(cells.select("cell", F.col(by).cast("string").alias("group")), "cell").groupBy("group", "module").agg(F.avg("me").alias("m"))
    return g.select("group", "module", F.greatest("m", F.lit(0.0)).alias("value"))


def feature_plot_data(mes: DataFrame, coords: DataFrame) -> DataFrame:
    """(module, cell, x, y, value, limit): scores on the first two coordinates; limit makes the range symmetric."""
    lim = F.max(F.abs("me")).over(Window.partitionBy("module"))
    return mes.join(coords.select("cell", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")), "cell").select("module", "cell", "x", "y", F.col("me").alias("value"), lim.alias("limit"))


def corr_network_data(mes: DataFrame, cells: DataFrame, by: str, module_cor: DataFrame, least: float = 0.2) -> DataFrame:
    """(m1, m2, cor, top_1, top_2): correlated modules, each with the group where its mean is largest."""
    g = mes.join(cells.select("cell", F.col(by).cast("string").alias("group")), "cell").groupBy("group", "module").agg(F.avg("me").alias("m"))
    top = g.groupBy("module").agg(F.max(F.struct(F.round("m", 9).alias("m"), "group")).alias("b")).select("module", F.col("b.group").alias("top"))
    x = module_cor.where(F.abs("cor") >= least)
    return x.join(top.select(F.col("module").alias("m1"), F.col("top").alias("top_1")), "m1").join(top.select(F.col("module").alias("m2"), F.col("top").alias("top_2")), "m2")


def volcano_data(dmes: DataFrame, p: str = "p_val") -> DataFrame:
    """Adds neg_log10_p and label; p of 0 takes the smallest other p."""
    x = dmes.where(F.col(p).isNotNull() & ~F.isnan(p))
    least = x.agg(F.coalesce(F.min(F.when(F.col(p) > 0, F.col(p))), F.lit(1e-300)).alias("__least"))  # one row
    x = x.crossJoin(F.broadcast(least)).withColumn("__p", F.when(F.col(p) > 0, F.col(p)).otherwise(F.col("__least")))
    return x.withColumns({"neg_log10_p": -F.log10("__p"), "label": F.when(F.col("p_val_adj") < 0.05, F.col("module")).otherwise("")}).drop("__p", "__least")


def network_edges(tom: DataFrame, modules: DataFrame, hubs: DataFrame, n_edges: int = 500) -> DataFrame:
    """(g1, g2, module, weight): the strongest links among a module's hub genes, scaled to the largest."""
    h = hubs.select("gene", "module")
    x = tom.join(h.select(F.col("gene").alias("g1"), "module"), "g1").join(h.select(F.col("gene").alias("g2"), F.col("module").alias("other")), "g2").where("module = other")
    w = Window.partitionBy("module")
    x = x.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("tom", 9)), "g1", "g2"))).where(F.col("r") <= n_edges)
    return x.select("g1", "g2", "module", (F.col("tom") / F.nullif(F.max("tom").over(w), F.lit(0.0))).alias("weight"))


def umap_features(tom: DataFrame, hubs: DataFrame) -> DataFrame:
    """(gene, hub, tom): overlap of every gene with every hub; 1 with itself."""
    h = hubs.select(F.col("gene").alias("hub"))
    x = both_ways(tom, "tom").join(h, F.col("j") == F.col("hub")).select(F.col("i").alias("gene"), "hub", "tom")
    return x.unionAll(hubs.select("gene", F.col("gene").alias("hub"), F.lit(1.0).alias("tom")))


def topology_heatmap(tom: DataFrame, kmes: DataFrame, modules: DataFrame, module: str, clip: float = 0.95) -> DataFrame:
    """(r1, r2, g1, g2, tom): one module's overlaps with its genes ranked by connectivity, clipped at a quantile."""
    own = hub_genes(modules.where(F.col("module") == module), kmes, 1 << 30).select("gene", "rank")
    x = tom.join(own.select(F.col("gene").alias("g1"), F.col("rank").alias("r1")), "g1").join(own.select(F.col("gene").alias("g2"), F.col("rank").alias("r2")), "g2")
    cap = x.agg(F.percentile("tom", F.lit(clip)).alias("cap"))
    return x.join(F.broadcast(cap), F.lit(True), "cross").select("r1", "r2", "g1", "g2", F.least("tom", "cap").alias("tom"))


def hub_heatmap(expr: DataFrame, cells: DataFrame, by: str, hubs: DataFrame, per_group: int = 200, seed: str = "42", limit: float = 2.5) -> DataFrame:
    """(group, cell, gene, z): hub expression of up to ``per_group`` cells per group (a plot's sample, by hash), standardised and clipped."""
    order = Window.partitionBy("group").orderBy(F.md5(F.concat_ws("#", F.lit(seed), "cell")), "cell")
    some = cells.select("cell", F.col(by).cast("string").alias("group")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_group)
    grid = some.select("cell", "group").crossJoin(F.broadcast(hubs.select("gene").distinct()))  # the rows of the plot, zeros among them
    x = grid.join(expr, ["cell", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    w = Window.partitionBy("gene")
    sd = F.stddev_samp("value").over(w)
    z = F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0)
    return x.select("group", "cell", "gene", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias("z"))


def regulon_bars(regs: DataFrame, tf: str, top: int = 10, least: float = 0.0) -> DataFrame:
    """(side, gene, gain): the positive targets of a regulator with the largest gain and the negative ones with the smallest."""
    x = regs.where((F.col("tf") == tf) & (F.abs("reg_score") > least)).withColumn("side", F.when(F.col("reg_score") > 0, "positive").otherwise("negative"))
    w = Window.partitionBy("side").orderBy(F.when(F.col("side") == "positive", -F.col("gain")).otherwise(F.col("gain")), "gene")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("side", "gene", "gain")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, ari, nmi) of two (gene, module) tables, from their contingency table."""
    x = a.select("gene", F.col("module").alias("a")).join(b.select("gene", F.col("module").alias("b")), "gene").groupBy("a", "b").agg(F.count("*").cast("double").alias("c"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    log = lambda c: F.sum(F.col(c) * F.ln(c))
    t = x.agg(F.sum("c").alias("n"), pairs("c").alias("p"), log("c").alias("l"))
    side = lambda k: x.groupBy(k).agg(F.sum("c").alias("s")).agg(pairs("s").alias(f"p{k}"), log("s").alias(f"l{k}"))
    t = t.join(side("a"), F.lit(True), "cross").join(side("b"), F.lit(True), "cross")
    n = F.col("n")
    expected = F.col("pa") * F.col("pb") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    ari = (F.col("p") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))
    ha, hb = F.ln(n) - F.col("la") / n, F.ln(n) - F.col("lb") / n
    mi = F.ln(n) + (F.col("l") - F.col("la") - F.col("lb")) / n
    return t.select(n.cast("long").alias("n"), F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(mi / F.nullif((ha + hb) / 2, F.lit(0.0)), F.lit(1.0)).alias("nmi"))
