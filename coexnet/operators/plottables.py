"""More tables behind plots: networks of hubs and regulators, bars, lollipops, heat tables and dot plots.

Every function returns rows for a renderer. ``place`` counts from 1 in drawing order; ties go by name.
Draws are orders of hashes. Null figures stay null and are drawn last; empty inputs give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coexnet.functions.stats import scale01, stars, t_p
from coexnet.operators import clustering
from coexnet.operators.modules import hub_genes, module_correlation, module_order
from coexnet.operators.network import both_ways
from coexnet.operators.regulation import targets_by_depth
from coexnet.operators.rounds import keep


def soft_power_plot(table: DataFrame, selected: int | None = None, least: float = 0.85) -> DataFrame:
    """``table`` with ``selected``: the given power, else the first whose fit reaches ``least``, else the last."""
    if selected is not None:
        return table.withColumn("selected", F.col("power") == selected)
    pick = table.agg(F.coalesce(F.min(F.when(F.col("sft_r_sq") >= least, F.col("power"))), F.max("power")).alias("__pick"))  # one row
    return table.crossJoin(F.broadcast(pick)).withColumn("selected", F.col("power") == F.col("__pick")).drop("__pick")


def kme_plot(modules: DataFrame, kmes: DataFrame, n_hubs: int = 10) -> DataFrame:
    """(module, gene, kme, place): a module's top genes, the least connected first."""
    w = Window.partitionBy("module").orderBy(F.desc("rank"))
    return hub_genes(modules, kmes, n_hubs).withColumn("place", F.row_number().over(w)).select("module", "gene", "kme", "place")


def keep_share(edges: DataFrame, group: str, value: str, share: float, by_hash: bool, seed: str) -> DataFrame:
    """A share of each group's edges (g1, g2), one at least: the largest, or the first in the order of a hash."""
    key = [F.md5(F.concat_ws("#", F.lit(seed), "g1", "g2"))] if by_hash else [F.desc(F.round(value, 9))]
    n = F.greatest(F.lit(1.0), F.bround(F.count("*").over(Window.partitionBy(group)) * F.lit(share)))
    r = F.row_number().over(Window.partitionBy(group).orderBy(*key, "g1", "g2"))
    return edges.withColumns({"__r": r, "__n": n}).where("__r <= __n").drop("__r", "__n")


def hub_network_edges(tom: DataFrame, modules: DataFrame, kmes: DataFrame, n_hubs: int = 3, n_other: int = 6, share: float = 0.5, sample: bool = False, seed: str = "42") -> DataFrame:
    """(g1, g2, kind, tom, weight): links among hubs and some other genes of every module.

    ``kind`` is the module of links inside one, else ``between``, of which the strongest max(3m, m + 5) of m modules are taken.
    Of each kind a share stays; the weight is scaled within the kind, 1 where all are equal.
    """
    named = modules.where("module <> 'grey'").select("gene", "module")
    hubs = hub_genes(modules, kmes, n_hubs).select("gene", "module")
    order = Window.partitionBy("module").orderBy(F.md5(F.concat_ws("#", F.lit(seed), "gene")), "gene")
    rest = named.join(hubs.select("gene"), "gene", "left_anti").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_other).select("gene", "module")
    nodes = hubs.unionAll(rest)
    ends = tom.join(nodes.select(F.col("gene").alias("g1"), F.col("module").alias("m1")), "g1").join(nodes.select(F.col("gene").alias("g2"), F.col("module").alias("m2")), "g2")
    m = named.select("module").distinct().count()
    inside = ends.where("m1 = m2").select("g1", "g2", F.col("m1").alias("kind"), "tom")
    between = ends.where("m1 <> m2").orderBy(F.desc(F.round("tom", 9)), "g1", "g2").limit(max(3 * m, m + 5)).select("g1", "g2", F.lit("between").alias("kind"), "tom")
    return scale01(keep_share(inside.unionAll(between), "kind", "tom", share, sample, seed), ["kind"], "tom", "weight", 1.0)


def umap_edges(tom: DataFrame, modules: DataFrame, hubs: DataFrame, share: float = 0.2, keep_between: bool = True, sample: bool = False, seed: str = "42") -> DataFrame:
    """(g1, g2, kind, tom, weight): links of genes (g1) with hubs (g2); ``between`` those of two modules. A share of each kind; 0.5 where all weights are equal."""
    m = modules.where("module <> 'grey'").select("gene", "module")
    x = both_ways(tom, "tom").where("tom > 0").join(hubs.select(F.col("gene").alias("j")), "j", "left_semi")
    x = x.join(m.select(F.col("gene").alias("i"), F.col("module").alias("m1")), "i").join(m.select(F.col("gene").alias("j"), F.col("module").alias("m2")), "j")
    x = x.select(F.col("i").alias("g1"), F.col("j").alias("g2"), F.when(F.col("m1") == F.col("m2"), F.col("m1")).otherwise("between").alias("kind"), "tom")
    x = x if keep_between else x.where("kind <> 'between'")
    return scale01(keep_share(x, "kind", "tom", share, sample, seed), ["kind"], "tom", "weight", 0.5)


def lollipop(dmes: DataFrame, p: str = "p_val") -> DataFrame:
    """(g1, g2, module, avg_log2fc, place, significant, size): modules of each comparison by rising change."""
    w = Window.partitionBy("g1", "g2")
    size = F.ln(F.count("*").over(Window.partitionBy("g1", "g2", "module")) + 1)
    place = F.row_number().over(w.orderBy(F.asc_nulls_last(F.round("avg_log2fc", 9)), "module"))
    return dmes.select("g1", "g2", "module", "avg_log2fc", place.alias("place"), F.coalesce(F.col(p) < 0.05, F.lit(False)).alias("significant"), size.alias("size"))


def trait_heat(cor: DataFrame, p: str = "fdr", limit: float | None = None, numeric: bool = False, digits: int = 3) -> DataFrame:
    """(trait, module, cor, label): correlations clipped at ``limit`` (the largest there is if not given), with stars or the p value where it is below 0.05."""
    label = F.when(F.col(p) < 0.05, F.format_number(p, digits)).otherwise("") if numeric else stars(F.col(p))
    bound = F.lit(limit) if limit is not None else F.max(F.abs("cor")).over(Window.partitionBy("trait"))
    return cor.select("trait", "module", F.greatest(-bound, F.least(bound, F.col("cor"))).alias("cor"), label.alias("label"))


def overlap_plot(overlap: DataFrame, value: str = "odds_ratio", log: bool = True, negate: bool = False) -> DataFrame:
    """(module, group, value, limit, place): an overlap figure, its logarithm or that negated, by rising value within each group; ``limit`` is where it stops to be remarkable."""
    form: Column = F.ln(F.greatest(F.col(value), F.lit(1e-300))) if log else F.col(value)
    at = {"odds_ratio": F.lit(1.0), "fdr": F.lit(0.05)}.get(value, F.lit(None).cast("double"))
    at, form = F.ln(at) if log else at, F.when(F.col(value).isNotNull(), form)
    at, form = (-at, -form) if negate else (at, form)
    x = overlap.select("module", "group", form.alias("value"), at.alias("limit"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.asc_nulls_last(F.round("value", 9)), "module")))


def motif_bars(overlap: DataFrame, n_tfs: int = 10) -> DataFrame:
    """(module, group, odds_ratio, place): the regulators with the largest odds ratios of each module; a null ratio comes last."""
    w = Window.partitionBy("module").orderBy(F.desc_nulls_last(F.round("odds_ratio", 9)), "group")
    return overlap.select("module", "group", "odds_ratio", F.row_number().over(w).alias("place")).where(F.col("place") <= n_tfs)


def enrichment_plot(enriched: DataFrame, top: int = 10, by: str = "module") -> DataFrame:
    """(by, library, term, neg_log10_p, gene_ratio, size, place): the terms of highest combined score of each group, for bars and dots."""
    w = Window.partitionBy(by)
    x = enriched.withColumn("place", F.row_number().over(w.orderBy(F.desc(F.round("combined_score", 9)), "library", "term"))).where(F.col("place") <= top)
    n = F.col("size_intersection").cast("double")
    size = F.greatest(F.lit(20.0), F.least(F.lit(300.0), n / F.nullif(F.max(n).over(w), F.lit(0.0)) * 200 + 20))
    return x.select(by, "library", "term", (-F.log10(F.greatest("pval", F.lit(1e-300)))).alias("neg_log10_p"), (n / F.nullif("size_set", F.lit(0))).alias("gene_ratio"), size.alias("size"), "place")


def preservation_plot(preserved: DataFrame, leave_out: tuple[str, ...] = ("gold", "grey")) -> DataFrame:
    """(module, z_summary, preservation, place): modules by rising z; those without one are left out."""
    x = preserved.where(F.col("z_summary").isNotNull() & ~F.col("module").isin(*leave_out))
    return x.select("module", "z_summary", "preservation", F.row_number().over(Window.orderBy(F.round("z_summary", 9), "module")).alias("place"))  # a row for each module


def topology_bars(modules: DataFrame, values: DataFrame, module: str, value: str = "kme") -> DataFrame:
    """(gene, value, place, alpha): a module's genes by falling connectivity; ``values`` is (gene, module, kme) or (gene, k)."""
    own = modules.where(F.col("module") == module).select("gene", "module")
    x = own.join(values, ["gene", "module"] if "module" in values.columns else "gene").select("gene", F.col(value).alias("value"))
    w = Window.partitionBy(F.lit(module))  # the genes of one module
    alpha = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.abs("value") / F.greatest(F.max(F.abs("value")).over(w), F.lit(1e-10))))
    return x.select("gene", "value", F.row_number().over(w.orderBy(F.desc(F.round("value", 9)), "gene")).alias("place"), alpha.alias("alpha"))


def tf_network_edges(regs: DataFrame, tfs: list[str], depth: int = 2, sign: str = "both", weight: str = "cor", limit: float = 0.75, least: float = 0.01, tfs_only: bool = False) -> DataFrame:
    """(tf, gene, weight, depth, degree): links around regulators, one row for each.

    The weight is the correlation or the signed gain (``reg_score``), clipped; ``depth`` is the least at which the target is met,
    0 for the selected; ``degree`` the number of a target's own targets, 0 if it is no regulator.
    """
    if weight not in ("cor", "reg_score"):
        raise ValueError(f"unknown weight {weight!r}")
    met = targets_by_depth(regs, tfs, depth, sign)
    depths = met.groupBy("gene").agg(F.min("depth").alias("depth"))
    degree = regs.groupBy(F.col("tf").alias("gene")).agg(F.count_distinct("gene").alias("degree"))
    links = met.select("tf", "gene").distinct().join(regs.select("tf", "gene", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(weight))).alias("weight")), ["tf", "gene"])
    x = links.where(F.abs("weight") >= least).join(depths, "gene").join(degree, "gene", "inner" if tfs_only else "left")
    return x.select("tf", "gene", "weight", F.when(F.col("gene").isin(*tfs), 0).otherwise(F.col("depth")).alias("depth"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _feature(net: DataFrame, feature: str, limit: float) -> Column:
    forms = {"positive": F.col("score_pos"), "negative": F.col("score_neg"), "delta": F.col("score_pos") - F.col("score_neg")}
    if feature not in forms:
        raise ValueError(f"unknown feature {feature!r}")
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), forms[feature]))


def regulatory_edges(net: DataFrame, feature: str = "delta", least: float = 0.5, limit: float = 1.0, source: str | None = None, target: str | None = None, loops: bool = True) -> DataFrame:
    """(source, target, score): links between modules whose clipped score reaches ``least``, of one source or target if given."""
    x = net.select("source", "target", _feature(net, feature, limit).alias("score")).where(F.abs("score") >= least)
    x = x.where(F.col("source") == source) if source is not None else x
    x = x.where(F.col("target") == target) if target is not None else x
    return x if loops else x.where("source <> target")


def regulatory_heat(net: DataFrame, feature: str = "delta", limit: float = 1.0, least_label: int = 3) -> DataFrame:
    """(source, target, score, label): the whole grid of modules; the label is the number of links, where there are ``least_label`` of them."""
    n = {"positive": F.col("n_pos"), "negative": F.col("n_neg")}.get(feature, F.lit(0))
    return net.select("source", "target", _feature(net, feature, limit).alias("score"), F.when(n >= least_label, n.cast("string")).otherwise("").alias("label"))


def regulatory_heat_order(heat: DataFrame) -> DataFrame:
    """(gene, place): modules in the order of Ward's tree over the rows (targets) of ``regulatory_heat``; one or two stay in natural order."""
    rows = heat.select(F.col("target").alias("gene"), F.col("source").alias("cell"), F.col("score").alias("value"))
    names = rows.select("gene").distinct()
    if names.limit(3).count() < 3:
        return names.select("gene", (F.row_number().over(Window.orderBy(module_order(F.col("gene")), "gene")) - 1).alias("place"))  # a row for each module
    return clustering.leaf_order(clustering.row_distances(rows), "square", "ward")


def correlogram(mes: DataFrame, order: str = "original", exclude_grey: bool = True) -> DataFrame:
    """(m1, m2, cor, p, place1, place2) of module scores for m1 < m2: Pearson, its two-sided p by Student's t, and the places to draw at.

    ``original`` is the natural order of names, ``alphabet`` that of strings, ``hclust`` the leaves of average linkage on ``1 - cor``. p is null below three cells.
    """
    if order not in ("original", "alphabet", "hclust"):
        raise ValueError(f"unknown order {order!r}")
    x = mes.where("module <> 'grey'") if exclude_grey else mes
    cor = module_correlation(x)
    n = x.groupBy("module").agg(F.count("*").alias("n"))
    if order == "hclust":
        cor = keep(cor)
        places = clustering.leaf_order(cor.toDF("g1", "g2", "cor"), "cor").withColumnRenamed("gene", "module")
    else:
        by = [module_order(F.col("module")), F.col("module")] if order == "original" else [F.col("module")]
        places = n.select("module", (F.row_number().over(Window.orderBy(*by)) - 1).alias("place"))  # a row for each module
    dof = (F.col("n") - 2).cast("double")
    t = F.abs("cor") * F.sqrt(dof / F.greatest(1 - F.col("cor") * F.col("cor"), F.lit(1e-300)))
    x = cor.join(n.withColumnRenamed("module", "m1"), "m1").withColumn("p", F.when(dof > 0, t_p(t, dof)))
    for e in "12":
        x = x.join(places.select(F.col("module").alias(f"m{e}"), F.col("place").alias(f"place{e}")), f"m{e}")
    return x.select("m1", "m2", "cor", "p", "place1", "place2")


def differential_regulon_plot(dregs: DataFrame, least_change: float = 0.1, n_label: int = 10) -> DataFrame:
    """``dregs`` with ``significant`` (both scores change, against each other, one of them significantly), ``is_deg``, ``quadrant`` and ``labelled``.

    Labelled are the significant ones with the largest and the smallest change of the positive score.
    """
    pos, neg = F.col("avg_log2fc_positive"), F.col("avg_log2fc_negative")
    sig = ((pos < 0) & (neg > 0) | (pos > 0) & (neg < 0)) & ((F.col("p_val_adj_positive") <= 0.05) | (F.col("p_val_adj_negative") <= 0.05))
    quadrant = F.when((pos == 0) | (neg == 0), F.lit(None)).otherwise(F.concat(F.when(neg > 0, "top-").otherwise("bottom-"), F.when(pos > 0, "right").otherwise("left")))
    x = dregs.withColumns({"significant": F.coalesce(sig, F.lit(False)), "is_deg": F.coalesce((F.abs("avg_log2fc_deg") >= least_change) & (F.col("p_val_adj_deg") < 0.05), F.lit(False)), "quadrant": quadrant})
    w = Window.partitionBy("significant")  # a row for each regulator
    up, down = (F.row_number().over(w.orderBy(by(F.round("avg_log2fc_positive", 9)), "tf")) for by in (F.desc, F.asc))
    return x.withColumn("labelled", F.col("significant") & (F.least(up, down) <= n_label))


def regulon_line(dregs: DataFrame) -> DataFrame:
    """(n, slope, intercept): least squares of the negative on the positive change; null below three regulators or where all changes are equal."""
    x, y = F.col("avg_log2fc_positive"), F.col("avg_log2fc_negative")
    s = dregs.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"))
    slope = F.when(F.col("n") > 2, F.col("xy") / F.nullif("xx", F.lit(0.0)))
    return s.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def centroids(coords: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """(group, x, y): mean of the first two coordinates of each group's cells."""
    x = coords.select("cell", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")).join(cells.select("cell", F.col(by).cast("string").alias("group")), "cell")
    return x.groupBy("group").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
