"""Regulator to target networks and regulons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.functions.stats import bh, normal_p, rank_sum


def hash_share(*cols) -> F.Column:
    """A number in [0, 1) fixed by the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *cols)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def synthetic_motifs(kmes: DataFrame, n_tfs: int = 100, density: float = 0.05, seed: str = "42") -> DataFrame:
    """(tf, gene): targets by hash for the genes with the largest connectivity to any module."""
    best = kmes.groupBy("gene").agg(F.max("kme").alias("k")).orderBy(F.desc(F.round("k", 9)), "gene").limit(n_tfs)
    pairs = best.select(F.col("gene").alias("tf")).join(kmes.select("gene").distinct(), F.lit(True), "cross")
    return pairs.where((F.col("tf") != F.col("gene")) & (hash_share(F.lit(seed), F.col("tf"), F.col("gene")) < density))


def named_motifs(names: DataFrame, genes: DataFrame, links: DataFrame) -> DataFrame:
    """(tf, gene) of given (tf, gene) links whose ends exist, matched without case."""
    g = genes.select("gene", F.upper("gene").alias("key"))
    tf = names.select(F.upper("tf").alias("key")).distinct().join(g, "key").select(F.col("key").alias("tf_key"), F.col("gene").alias("tf"))
    x = links.select(F.upper("tf").alias("tf_key"), F.upper("gene").alias("key")).distinct()
    return x.join(tf, "tf_key").join(g, "key").select("tf", "gene")


def tf_gene_cor(motifs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tf, gene, cor) of every link, from the (g1, g2, cor) table."""
    x = motifs.where("tf <> gene").withColumns({"g1": F.least("tf", "gene"), "g2": F.greatest("tf", "gene")})
    return x.join(pairs, ["g1", "g2"]).select("tf", "gene", "cor")


def regulons(edges: DataFrame, strategy: str = "A", least_gain: float = 0.01, n_tfs: int = 10, n_genes: int = 50) -> DataFrame:
    """(tf, gene, gain, cor, reg_score): A top regulators of each gene, B top genes of each regulator, C all."""
    x = edges.where(F.col("gain") >= least_gain)
    if strategy in ("A", "B"):
        key, other, n = ("gene", "tf", n_tfs) if strategy == "A" else ("tf", "gene", n_genes)
        w = Window.partitionBy(key).orderBy(F.desc("gain"), other)
        x = x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    elif strategy != "C":
        raise ValueError(f"unknown strategy {strategy!r}")
    return x.select("tf", "gene", "gain", "cor", (F.col("gain") * F.signum("cor")).alias("reg_score"))


def targets_by_depth(regs: DataFrame, tfs: list[str], depth: int = 1, sign: str = "both") -> DataFrame:
    """(depth, tf, gene, reg_score): links that start at the frontier, which keeps all it has met.

    ``depth`` is a few steps chosen by the caller; each is one semi join.
    """
    x = regs if sign == "both" else regs.where(F.col("reg_score") >= 0 if sign == "positive" else F.col("reg_score") < 0)
    front = regs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tfs)], "tf string")
    if front.join(regs.select("tf").distinct(), "tf", "left_anti").limit(1).count():
        raise ValueError("a selected regulator has no regulon")
    out = None
    for d in range(1, depth + 1):
        step = x.join(front, "tf", "left_semi").select(F.lit(d).alias("depth"), "tf", "gene", "reg_score")
        out = step if out is None else out.unionAll(step)
        front = front.union(step.select("gene").distinct()).distinct()
    return out


def module_regulation(regs: DataFrame, modules: DataFrame, tfs_only: bool = True) -> DataFrame:
    """(source, target, n_pos, sum_pos, n_neg, sum_neg, score_pos, score_neg) on the full grid of modules."""
    m = modules.select("gene", "module")
    e = regs.join(m.select(F.col("gene").alias("tf"), F.col("module").alias("source")), "tf").join(m.select("gene", F.col("module").alias("target")), "gene")
    if tfs_only:
        e = e.join(regs.select(F.col("tf").alias("gene")).distinct(), "gene", "left_semi")
    pos = F.col("reg_score") >= 0
    s = e.groupBy("source", "target").agg(F.count_if(pos).alias("n_pos"), F.sum(F.when(pos, F.col("reg_score")).otherwise(0.0)).alias("sum_pos"), F.count_if(~pos).alias("n_neg"), F.sum(F.when(~pos, F.col("reg_score")).otherwise(0.0)).alias("sum_neg"))
    names = m.select("module").distinct()
    grid = names.select(F.col("module").alias("source")).join(names.select(F.col("module").alias("target")), F.lit(True), "cross")
    n_tf = regs.select(F.col("tf").alias("gene")).distinct().join(m, "gene").groupBy(F.col("module").alias("source")).agg(F.count("*").alias("n_tf"))
    x = grid.join(s, ["source", "target"], "left").join(n_tf, "source", "left")
    n, total = lambda c: F.coalesce(c, F.lit(0)), lambda c: F.coalesce(c, F.lit(0.0))
    return x.select("source", "target", n("n_pos").alias("n_pos"), total("sum_pos").alias("sum_pos"), n("n_neg").alias("n_neg"), total("sum_neg").alias("sum_neg"), (n("n_pos") / F.coalesce("n_tf", F.lit(1))).alias("score_pos"), (n("n_neg") / F.coalesce("n_tf", F.lit(1))).alias("score_neg"))


def regulon_scores(dense: DataFrame, regs: DataFrame, sign: str = "positive", least_cor: float = 0.05, modules: DataFrame | None = None) -> DataFrame:
    """(cell, tf, score): one less the scaled mean rank of a regulon's targets among all genes of the cell (largest value first).

    With ``modules`` (gene, module), links that start or end at a grey gene are left out.
    """
    if modules is not None:
        grey = modules.where("module = 'grey'").select("gene")
        regs = regs.join(grey, "gene", "left_anti").join(grey.withColumnRenamed("gene", "tf"), "tf", "left_anti")
    if sign not in ("positive", "negative", "both"):
        raise ValueError(f"unknown target type {sign!r}")
    keep = {"positive": F.col("cor") > least_cor, "negative": F.col("cor") < -least_cor, "both": F.abs("cor") > least_cor}[sign]
    w = Window.partitionBy("cell").orderBy(F.desc("value"), "gene")
    n = F.count("*").over(Window.partitionBy("cell"))
    ranked = dense.select("cell", "gene", ((F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)).cast("double")).alias("r"))
    return ranked.join(regs.where(keep).select("tf", "gene"), "gene").groupBy("cell", "tf").agg((1 - F.avg("r")).alias("score"))


def differential_regulons(pos: DataFrame, neg: DataFrame, expr: DataFrame, groups: DataFrame, modules: DataFrame, kmes: DataFrame) -> DataFrame:
    """Wilcoxon tests of regulon scores and regulator expression between the cells of (cell, first); changes are first less second."""

    def test(scores: DataFrame, tag: str) -> DataFrame:
        x = scores.join(groups, "cell").withColumn("score", F.round("score", 12))  # sums in another order tie all the same
        s = rank_sum(x, ["tf"], "score", F.col("first"))
        p = s.select("tf", F.when(F.least("n1", "n2") < 3, 1.0).otherwise(normal_p("z")).alias(f"p_val_{tag}"))
        fold = x.groupBy("tf").agg((F.avg(F.when(F.col("first"), F.col("score"))) - F.avg(F.when(~F.col("first"), F.col("score")))).alias(f"avg_log2fc_{tag}"))
        return bh(p.join(fold, "tf"), f"p_val_{tag}", [], f"p_val_adj_{tag}")

    tfs = pos.select("tf").distinct()
    own = tfs.join(groups.select("cell"), F.lit(True), "cross").join(expr.select("cell", F.col("gene").alias("tf"), "value"), ["cell", "tf"], "left").select("cell", "tf", F.coalesce("value", F.lit(0.0)).alias("score"))
    best = kmes.groupBy(F.col("gene").alias("tf")).agg(F.max("kme").alias("kme"))
    x = test(pos, "positive").join(test(neg, "negative"), "tf").join(test(own, "deg"), "tf", "left")
    x = x.withColumns({"p_val_deg": F.coalesce("p_val_deg", F.lit(1.0)), "avg_log2fc_deg": F.coalesce("avg_log2fc_deg", F.lit(0.0))})
    return x.join(modules.select(F.col("gene").alias("tf"), "module"), "tf", "left").join(best, "tf", "left")
