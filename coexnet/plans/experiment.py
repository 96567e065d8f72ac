"""A fluent experiment: named tables of one analysis, kept in memory or as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coexnet.operators import analysis, boosting, clustering, correlation, features, harmony, metacells, modules, network, projection, regulation
from coexnet.operators.rounds import keep


class Experiment:
    """Steps return the experiment itself, so they chain; tables are read with ``get``.

    ``expr`` is a sparse (cell, gene, value) table of counts or values, ``cells`` has a row per cell.
    """

    def __init__(self, spark: SparkSession, expr: DataFrame, cells: DataFrame, name: str = "default"):
        self.spark, self.name, self.params = spark, name, {}
        self.slots: dict[str, DataFrame] = {"expr": expr, "cells": cells}

    def __repr__(self) -> str:
        return f"Experiment({self.name!r}: {', '.join(self.slots)})"

    def get(self, slot: str) -> DataFrame:
        if slot not in self.slots:
            raise ValueError(f"experiment {self.name!r} has no {slot!r} yet")
        return self.slots[slot]

    def maybe(self, slot: str) -> DataFrame | None:
        return self.slots.get(slot)

    def put(self, slot: str, df: DataFrame, **params) -> Experiment:
        self.slots[slot] = df
        self.params |= params
        return self

    def _cells(self) -> int:
        if "n_cells" not in self.params:
            self.params["n_cells"] = self.get("cells").count()
        return self.params["n_cells"]

    def setup(self, select: str = "fraction", fraction: float = 0.05, n_genes: int = 3000, genes: list[str] | None = None, flags: DataFrame | None = None) -> Experiment:
        """Choose genes; the working matrix ``dat_expr`` holds them, without constant ones.

        ``variable`` takes the first ``n_genes`` marked in ``flags`` (gene, highly_variable, and place if there is an order), without it the most variable.
        """
        expr, n = self.get("expr"), self._cells()
        pick = {"fraction": lambda: features.gene_fraction(expr, n, fraction), "variable": lambda: features.gene_cv2(expr, n, n_genes) if flags is None else features.gene_flagged(expr, flags, n_genes=n_genes, place="place" if "place" in flags.columns else None), "custom": lambda: features.gene_custom(expr, genes or [])}
        if select not in pick:
            raise ValueError(f"unknown selection {select!r}")
        chosen = pick[select]().select("gene")
        return self.put("genes", chosen, gene_select=select).set_dat_expr(use_metacells=False)

    def set_dat_expr(self, group_by: str | None = None, groups: list[str] | None = None, use_metacells: bool = True) -> Experiment:
        """The working matrix: chosen genes of cells, or of metacells if there are any; ``groups`` of the column ``group_by``, or of the metacells' groups."""
        if use_metacells and "metacell_expr" in self.slots:
            expr, cells = self.get("metacell_expr"), self.get("metacell_members").select(F.col("metacell").alias("cell"), "group").distinct()
            if groups:
                cells = cells.where(F.col("group").isin(groups) if group_by is None else F.split("group", "#")[self.params["metacell_by"].index(group_by)].isin(groups))
        else:
            expr, cells = self.get("expr"), self.get("cells")
            if group_by and groups:
                cells = cells.where(F.col(group_by).isin(groups))
        cells = cells.select("cell")
        expr = expr.join(cells, "cell", "left_semi").join(self.get("genes"), "gene", "left_semi")
        n = cells.count()
        good = features.good_genes(expr, n).select("gene")
        if good.limit(2).count() < 2:
            raise ValueError("fewer than two usable genes")
        return self.put("dat_expr", expr.join(good, "gene", "left_semi"), n_dat=n).put("dat_cells", cells)

    def normalize(self) -> Experiment:
        return self.put("expr", features.log_normalize(self.get("expr")))

    def metacells_by_groups(self, by: list[str], coords: DataFrame, k: int = 25, max_shared: int = 15, min_cells: int = 100, target: int | None = 1000) -> Experiment:
        expr, members = metacells.metacells_by_groups(self.get("expr"), self.get("cells"), coords, by, k, max_shared, min_cells, target)
        return self.put("metacell_expr", expr, metacell_by=list(by)).put("metacell_members", members)

    def pairs(self, method: str = "pearson", plan: str = "blocked") -> Experiment:
        return self.put("pairs", correlation.correlate(self.get("dat_expr"), self.params["n_dat"], method, plan), cor_method=method)

    def test_soft_powers(self, network_type: str = "signed", method: str = "pearson") -> Experiment:
        self.pairs(method).put("power_table", network.power_table(self.get("pairs"), network=network_type))
        self.params["power"] = network.select_power(self.get("power_table"))
        return self

    def construct_network(self, power: int | None = None, network_type: str = "signed", denominator: str = "min", min_size: int = 20, cut: str = "hybrid", height: float = 0.8, cut_height: float | None = 0.995, merge_height: float = 0.2, deep_split: int = 4, pam: bool = True, within_branch: bool = False, merge_rounds: int = 1) -> Experiment:
        """Modules of the working matrix; ``network_mes`` are their scores in it, computed anew where modules were merged."""
        if "pairs" not in self.slots:
            self.pairs()
        self.put("pairs", keep(self.get("pairs")))  # read by every step from here on
        adj = network.adjacency(self.get("pairs"), power or self.params.get("power", 6), network_type)
        self.put("degrees", network.degrees(adj)).put("tom", keep(network.topological_overlap(adj, denominator, "blocked")))
        found = clustering.detect_modules(self.get("tom"), cut, height, cut_height, min_size, deep_split=deep_split, pam=pam, within_branch=within_branch)
        scores_of = lambda m: modules.eigengenes(self.get("dat_expr"), m, self.params["n_dat"], cells=self.get("dat_cells"))
        merged, scores = clustering.merge_modules(found, scores_of, modules.module_correlation, merge_height, merge_rounds)
        return self.put("modules", merged).put("network_mes", scores)

    def dendrogram(self, hang: float = 0.03) -> tuple[DataFrame, DataFrame]:
        return clustering.dendrogram(self.get("tom"), hang)

    def module_eigengenes(self, batch: list[str] | None = None, correction: str = "harmony", n_runs: int = 1, n_components: int = 30) -> Experiment:
        """Scores of all cells, with ``batch`` also corrected: by ``harmony`` (the mean of ``n_runs`` of them) or by ``means``."""
        if correction not in ("harmony", "means"):
            raise ValueError(f"unknown correction {correction!r}")
        expr = self.get("expr").join(self.get("genes"), "gene", "left_semi")
        me = modules.eigengenes(expr, self.get("modules"), self._cells(), cells=self.get("cells"))
        self.put("mes", me)
        if not batch:
            return self
        if correction == "means":
            return self.put("hmes", modules.harmonize(me, self.get("cells"), batch))
        z = modules.component_scores(expr, self.get("modules"), self._cells(), n_components, cells=self.get("cells"))
        fixed = harmony.harmony_consensus(z, self.get("cells"), batch, n_runs, start="parallel")
        return self.put("hmes", fixed.select("cell", "module", F.col("z")[0].alias("me")))

    def get_mes(self, harmonized: bool = True) -> DataFrame:
        return self.slots["hmes"] if harmonized and "hmes" in self.slots else self.get("mes")

    def module_connectivity(self, method: str = "pearson") -> Experiment:
        expr = self.get("expr").join(self.get("genes"), "gene", "left_semi")
        if method == "bicor":
            return self.put("kme", modules.kme_bicor(expr, self.get_mes(), self._cells()))
        if method != "pearson":
            raise ValueError(f"unknown method {method!r}")
        return self.put("kme", modules.kme(expr, self.get_mes(), self._cells()))

    def project(self, target: DataFrame, target_cells: DataFrame) -> DataFrame:
        expr = self.get("expr").join(self.get("genes"), "gene", "left_semi")
        return projection.project_modules(expr, target, self.get("modules"), self._cells(), target_cells.count(), cells=target_cells)

    def regulon_scores(self, sign: str = "positive", least_cor: float = 0.05, exclude_grey_genes: bool = True) -> Experiment:
        dense = correlation.densify(self.get("expr"), self.get("cells"), self.get("genes"))
        return self.put(f"regulon_scores_{sign}", regulation.regulon_scores(dense, self.get("tf_regulons"), sign, least_cor, self.maybe("modules") if exclude_grey_genes else None))

    def find_differential_regulons(self, groups: DataFrame) -> DataFrame:
        pos, neg = self.get("regulon_scores_positive"), self.get("regulon_scores_negative")
        return regulation.differential_regulons(pos, neg, self.get("expr"), groups, self.get("modules"), self.get("kme"))

    def overlap_modules_motifs(self, motifs: DataFrame) -> DataFrame:
        m = self.get("modules")
        return analysis.overlap_test(analysis.overlap_counts(m, motifs, "tf"), m.count())

    def get_hub_genes(self, n_hubs: int = 10) -> DataFrame:
        return modules.hub_genes(self.get("modules"), self.get("kme"), n_hubs)

    def reset_module_names(self, prefix: str = "M") -> Experiment:
        return self.put("modules", modules.rename_modules(self.get("modules"), prefix).select("gene", F.col("new_module").alias("module")))

    def reassign_modules(self, by_hand: dict[str, str] | None = None, ignore: bool = False) -> Experiment:
        if by_hand is not None:
            return self.put("modules", modules.reassign_manual(self.get("modules"), by_hand, ignore))
        return self.put("modules", modules.reassign_negative(self.get("modules"), self.get("kme")).select("gene", F.col("new_module").alias("module")))

    def find_all_dmes(self, by: str, test: str = "wilcox") -> DataFrame:
        return analysis.find_dmes(self.get_mes(), self.get("cells"), by, test)

    def module_trait_correlation(self, traits: list[str], method: str = "pearson") -> DataFrame:
        return analysis.trait_p_values(analysis.trait_correlation(self.get_mes(), self.get("cells"), traits, method))

    def overlap_modules_degs(self, deg: DataFrame, fc_cutoff: float = 0.5, group_col: str = "cluster") -> DataFrame:
        m = self.get("modules")
        return analysis.overlap_test(analysis.overlap_counts(m, analysis.deg_sets(deg, fc_cutoff, group_col)), m.count())

    def module_expr_score(self, n_genes: int | str = 25) -> Experiment:
        return self.put("module_scores", analysis.module_score(self.get("expr"), analysis.top_genes(self.get("modules"), self.get("kme"), n_genes), self._cells()))

    def avg_module_expr(self, n_genes: int | str = 25) -> Experiment:
        return self.put("avg_module_expr", analysis.average_expression(self.get("expr"), analysis.top_genes(self.get("modules"), self.get("kme"), n_genes)))

    def enrichment(self, gene_sets: DataFrame) -> DataFrame:
        return analysis.enrichment(self.get("modules"), gene_sets)

    def enrich_regulons(self, gene_sets: DataFrame, least_genes: int = 5) -> Experiment:
        return self.put("regulon_enrichment", analysis.enrich_regulons(self.get("tf_regulons"), self.get("modules"), gene_sets, least_genes))

    def module_preservation(self, tom: DataFrame | None = None, n_permutations: int = 100) -> DataFrame:
        return projection.preservation(tom or self.get("tom"), self.get("modules"), n_permutations)

    def construct_tf_network(self, motifs: DataFrame, rounds: int = 100, folds: int = 5, patience: int = 10) -> Experiment:
        """Regulators of every gene by boosted trees, as many as cross-validation tells; its errors are in ``tf_eval``."""
        links, errors = boosting.boost(self.get("dat_expr"), motifs, rounds, folds=folds, patience=patience)
        return self.put("tf_network", links.join(regulation.tf_gene_cor(motifs, self.get("pairs")), ["tf", "gene"])).put("tf_eval", errors)

    def assign_tf_regulons(self, strategy: str = "A", least_gain: float = 0.01, n_tfs: int = 10, n_genes: int = 50) -> Experiment:
        return self.put("tf_regulons", regulation.regulons(self.get("tf_network"), strategy, least_gain, n_tfs, n_genes))

    def write(self, root: str) -> Experiment:
        """Write every table as ``root/name/slot`` and read them back, which also cuts their lineage."""
        for slot, df in list(self.slots.items()):
            path = f"{root}/{self.name}/{slot}"
            df.write.mode("overwrite").parquet(path)
            self.slots[slot] = self.spark.read.parquet(path)
        rows = self.spark.createDataFrame([(json.dumps(self.params), json.dumps(list(self.slots)))], "params string, slots string")
        rows.coalesce(1).write.mode("overwrite").json(f"{root}/{self.name}/_experiment")
        return self

    @classmethod
    def read(cls, spark: SparkSession, root: str, name: str = "default") -> Experiment:
        row = spark.read.json(f"{root}/{name}/_experiment").first()
        slots = {s: spark.read.parquet(f"{root}/{name}/{s}") for s in json.loads(row["slots"])}
        out = cls(spark, slots["expr"], slots["cells"], name)
        out.slots, out.params = slots, json.loads(row["params"])
        return out
