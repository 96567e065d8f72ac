"""Differential module scores, trait correlation, overlap, module scores and over-representation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coexnet.functions.stats import bh, fisher_greater, mean_ranks, mwu_p, normal_p, rank_sum, stars, t_p, welch
from coexnet.operators.modules import hub_genes


def group_pairs(mes: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """(g1, g2, module, cell, me, first) for all pairs of groups g1 < g2: each score once per pair its group is in."""
    named = cells.select("cell", F.col(by).cast("string").alias("group")).where("group is not null")
    names = named.select("group").distinct()
    pairs = names.select(F.col("group").alias("g1")).join(names.select(F.col("group").alias("g2")), F.col("g1") < F.col("g2"))
    side = F.explode(F.array(F.struct(F.col("g1").alias("group"), F.lit(True).alias("first")), F.struct(F.col("g2").alias("group"), F.lit(False).alias("first"))))
    sides = pairs.select("g1", "g2", side.alias("s")).select("g1", "g2", "s.group", "s.first")
    return mes.join(named, "cell").join(sides, "group").select("g1", "g2", "module", "cell", "me", "first")


def dme_effects(paired: DataFrame) -> DataFrame:
    """(g1, g2, module, pct_1, pct_2, avg_log2fc, n_1, n_2); the change is the mean of group 2 less that of group 1."""
    one = F.col("first")
    share = lambda c: F.round(F.avg(F.when(c, (F.col("me") != 0).cast("double"))), 4)
    return paired.groupBy("g1", "g2", "module").agg(
        share(one).alias("pct_1"), share(~one).alias("pct_2"), (F.avg(F.when(~one, F.col("me"))) - F.avg(F.when(one, F.col("me")))).alias("avg_log2fc"),
        F.count_if(one).alias("n_1"), F.count_if(~one).alias("n_2"),
    )


def find_dmes(mes: DataFrame, cells: DataFrame, by: str, test: str = "wilcox", min_cells: int = 3) -> DataFrame:
    """All pairs of groups: effects, p value and its Benjamini-Hochberg value within the pair.

    Wilcoxon is exact up to 8 cells in a group without ties, else normal with ties and continuity. Groups of under ``min_cells`` are left out.
    """
    paired = group_pairs(mes, cells, by)
    by_pair = ["g1", "g2", "module"]
    effects = dme_effects(paired).where((F.col("n_1") >= min_cells) & (F.col("n_2") >= min_cells))
    if test == "wilcox":
        ties = paired.groupBy(*by_pair).agg((F.count("*") != F.count_distinct("me")).alias("tied"))
        s = rank_sum(paired, by_pair, "me", F.col("first")).join(ties, by_pair)
        small = ~F.col("tied") & (F.least("n1", "n2") <= 8)
        p = s.where(~small).select(*by_pair, normal_p("z").alias("p_val")).unionAll(s.where(small).select(*by_pair, mwu_p("u1", "n1", "n2").alias("p_val")))
    elif test == "t":
        p = welch(paired, by_pair, "me", F.col("first")).select(*by_pair, t_p("t", "df").alias("p_val"))
    else:
        p = effects.select(*by_pair, F.lit(1.0).alias("p_val"))
    return bh(effects.join(p, by_pair, "left"), "p_val", ["g1", "g2"], "p_val_adj")


def trait_correlation(mes: DataFrame, cells: DataFrame, traits: list[str], method: str = "pearson", least: int = 10) -> DataFrame:
    """(trait, module, n, cor): correlation of module scores with numeric traits; traits with under ``least`` values are left out."""
    long = cells.select("cell", *(F.col(t).cast("double").alias(t) for t in traits)).unpivot("cell", traits, "trait", "x").where("x is not null and not isnan(x)")
    both = long.join(mes.where("me is not null"), "cell")
    if method == "spearman":
        both = mean_ranks(mean_ranks(both, ["trait", "module"], "x", "rx"), ["trait", "module"], "me", "ry").select("trait", "module", F.col("rx").alias("x"), F.col("ry").alias("me"))
    n = F.col("n").cast("double")
    centre = both.groupBy("trait", "module").agg(F.avg("x").alias("ax"), F.avg("me").alias("ay"))
    c = both.join(centre, ["trait", "module"]).select("trait", "module", (F.col("x") - F.col("ax")).alias("x"), (F.col("me") - F.col("ay")).alias("y"))
    s = c.groupBy("trait", "module").agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "xy")))
    r = F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))
    return s.where(n >= least).select("trait", "module", "n", F.coalesce(r, F.lit(0.0)).alias("cor"))


def trait_p_values(cor: DataFrame) -> DataFrame:
    """Adds pval (Student's t) and fdr within each trait."""
    t = F.col("cor") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("cor") * F.col("cor"), F.lit(1e-300)))
    return bh(cor.withColumn("pval", t_p(t, (F.col("n") - 2).cast("double"))), "pval", ["trait"])


def overlap_counts(modules: DataFrame, sets: DataFrame, set_col: str = "group") -> DataFrame:
    """(module, group, size_module, size_set, size_intersection) on the full grid; ``modules`` is the universe."""
    m = modules.where("module <> 'grey'").groupBy("module").agg(F.count("*").alias("size_module"))
    inside = sets.select("gene", F.col(set_col).alias("group")).distinct().join(modules.select("gene", "module"), "gene")
    s = inside.groupBy("group").agg(F.count("*").alias("size_set"))
    both = inside.groupBy("module", "group").agg(F.count("*").alias("size_intersection"))
    return m.join(s, F.lit(True), "cross").join(both, ["module", "group"], "left").select("module", "group", "size_module", "size_set", F.coalesce("size_intersection", F.lit(0)).alias("size_intersection"))


def overlap_test(counts: DataFrame, universe: int) -> DataFrame:
    """Adds odds_ratio, odds_ratio_marginal, jaccard, pval (Fisher, greater), fdr and stars.

    The marginal ratio takes the sizes of module and set for the discordant counts.
    """
    a = F.col("size_intersection").cast("double")
    b, c = F.col("size_module") - a, F.col("size_set") - a
    d = F.lit(float(universe)) - a - b - c
    x = counts.withColumns({"odds_ratio": a * d / F.nullif(b * c, F.lit(0.0)), "odds_ratio_marginal": a * d / F.nullif((a + b) * (a + c), F.lit(0.0)), "jaccard": a / F.nullif(a + b + c, F.lit(0.0)), "pval": fisher_greater(F.col("size_intersection"), F.col("size_module"), F.col("size_set"), F.lit(universe))})
    return bh(x, "pval", []).withColumn("significance", stars(F.col("fdr")))


def deg_sets(deg: DataFrame, fc_cutoff: float = 0.5, group_col: str = "cluster") -> DataFrame:
    """(gene, group) of the differential genes; a negative cutoff selects what falls below it."""
    fold = F.col("avg_log2FC")
    return deg.where((F.col("p_val_adj") <= 0.05) & (fold > fc_cutoff if fc_cutoff >= 0 else fold < fc_cutoff)).select("gene", F.col(group_col).alias("group"))


def average_expression(expr: DataFrame, tops: DataFrame) -> DataFrame:
    """(cell, module, score): mean over each module's genes in ``tops``, zeros included."""
    size = tops.groupBy("module").agg(F.count("*").alias("size"))
    s = expr.join(tops.select("module", "gene"), "gene").groupBy("cell", "module").agg(F.sum("value").alias("s"))
    return s.join(size, "module").select("cell", "module", (F.col("s") / F.col("size")).alias("score"))


def expression_bins(expr: DataFrame, n_cells: int, n_bins: int = 25) -> DataFrame:
    """(gene, mean, bin, place): the bin between quantiles of the positive gene means that holds a gene.

    ``bin`` counts a mean on an inner edge to the upper bin, as a control; ``place`` to the lower one, as a feature.
    """
    m = expr.groupBy("gene").agg(F.round(F.sum("value") / F.lit(float(n_cells)), 9).alias("mean"))
    edges = m.where("mean > 0").agg(F.percentile("mean", F.array(*(F.lit(i / n_bins) for i in range(1, n_bins)))).alias("edges"))  # one row
    below = lambda test: F.coalesce(F.size(F.filter("edges", test)), F.lit(0))
    return m.crossJoin(F.broadcast(edges)).select("gene", "mean", below(lambda e: e <= F.col("mean")).alias("bin"), below(lambda e: e < F.col("mean")).alias("place"))


def module_score(expr: DataFrame, tops: DataFrame, n_cells: int, n_bins: int = 25, seed: str = "42") -> DataFrame:
    """(cell, module, score): mean of a module's top genes less the mean of control genes.

    For each module and bin of a feature the controls are as many of the bin's other genes as the module has features,
    drawn in the order of a hash; each control counts once. Modules without a control are left out.
    """
    bins = expression_bins(expr, n_cells, n_bins)
    tops = tops.select("module", "gene").distinct()
    size = tops.groupBy("module").agg(F.count("*").alias("size"))
    wanted = tops.join(bins.select("gene", F.col("place").alias("bin")), "gene").select("module", "bin").distinct().join(size, "module")
    pool = wanted.join(bins.select("gene", "bin"), "bin").join(tops, ["module", "gene"], "left_anti")
    order = Window.partitionBy("module", "bin").orderBy(F.md5(F.concat(F.lit(seed), F.lit("#"), "module", F.lit("#"), "gene")), "gene")
    control = pool.withColumn("r", F.row_number().over(order)).where("r <= size").select("module", "gene").distinct()
    a, b = average_expression(expr, tops.join(control.select("module").distinct(), "module", "left_semi")), average_expression(expr, control).withColumnRenamed("score", "base")
    return a.join(b, ["cell", "module"], "full").select("cell", "module", (F.coalesce("score", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("score"))


def top_genes(modules: DataFrame, kmes: DataFrame, n_genes: int | str = 25) -> DataFrame:
    return modules.where("module <> 'grey'").select("module", "gene") if n_genes == "all" else hub_genes(modules, kmes, int(n_genes)).select("module", "gene")


def combined_score() -> Column:
    """-ln(p) times the odds ratio of an overlap row; where a discordant count is 0, a half is added to all four."""
    a = F.col("size_intersection").cast("double")
    b, c = F.col("size_module") - a, F.col("size_set") - a
    d = F.col("universe") - a - b - c
    odds = F.when(b * c > 0, a * d / F.nullif(b * c, F.lit(0.0))).otherwise((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    return -F.ln(F.greatest("pval", F.lit(1e-300))) * odds


def enrichment(modules: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Over-representation of (library, term, gene) sets in modules: (library, term, module, ..., pval, fdr, combined_score)."""
    key = F.concat_ws("\u0001", "library", "term")
    counts = overlap_counts(modules, gene_sets.select("gene", key.alias("group")))
    universe = modules.select("gene").distinct().count()
    x = overlap_test(counts, universe)
    parts = F.split("group", "\u0001")
    x = x.withColumn("universe", F.lit(universe)).withColumn("combined_score", combined_score()).drop("universe")
    return x.where("size_intersection > 0").select(parts[0].alias("library"), parts[1].alias("term"), *[c for c in x.columns if c != "group"])


def enrich_regulons(regs: DataFrame, genes: DataFrame, gene_sets: DataFrame, least_genes: int = 5) -> DataFrame:
    """Over-representation of gene sets among the positive and the negative targets of every regulator.

    (tf, target_type, library, term, size_module, size_set, size_intersection, pval, fdr, combined_score); ``size_module`` is the number of
    targets. ``genes`` is the universe; target lists of under ``least_genes`` are left out, as are links of correlation 0. The fdr is taken
    within a regulator's side and library.
    """
    side = F.when(F.col("cor") > 0, "positive").when(F.col("cor") < 0, "negative")
    known = genes.select("gene").distinct()
    targets = regs.select("tf", side.alias("target_type"), "gene").where("target_type is not null").distinct().join(known, "gene", "left_semi")
    size = targets.groupBy("tf", "target_type").agg(F.count("*").alias("size_module")).where(F.col("size_module") >= least_genes)
    sets = gene_sets.select("library", "term", "gene").distinct().join(known, "gene", "left_semi")
    total = sets.groupBy("library", "term").agg(F.count("*").alias("size_set"))
    both = targets.join(sets, "gene").groupBy("tf", "target_type", "library", "term").agg(F.count("*").alias("size_intersection"))
    x = both.join(size, ["tf", "target_type"]).join(total, ["library", "term"]).withColumn("universe", F.lit(known.count()))
    x = x.withColumn("pval", fisher_greater("size_intersection", "size_module", "size_set", "universe"))
    x = bh(x.withColumn("combined_score", combined_score()), "pval", ["tf", "target_type", "library"])
    return x.select("tf", "target_type", "library", "term", "size_module", "size_set", "size_intersection", "pval", "fdr", "combined_score")
