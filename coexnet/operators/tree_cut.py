"""Hybrid cut of a gene tree: branches by shape, then the genes left over by distance.

The rule is that of Langfelder, Zhang and Horvath (Bioinformatics 24, 2008, "Defining clusters from a hierarchical cluster
tree"), in its hybrid form. Going up the tree, two branches that meet stay apart if each has enough genes, a tight core and a gap between
its core's mean distance (scatter) and the meeting; otherwise the failing one, the smaller first, is taken into the other. The largest
scatter and the least gap are shares of the range of heights that ``deep_split`` (0 to 4) sets. Then every gene without a cluster meets
the mean distance to all clusters and joins the nearest, if that is below the cut height or the cluster's own diameter.

The tree has one merge less than genes and is walked on the driver. Distances are never there: the cores a walk asks for are summed by a
join with the table of pairs, and it is walked again until it asks for nothing new (what isn't known yet counts as loose, which is
mostly right, so that the walk gets on). The step by distance is a join of the pairs with the labels and sums by gene and cluster.
Pairs that are not listed are at distance 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.rounds import keep

#: Largest core scatter for each ``deep_split``, as a share of the range of heights (fixed values of the published rule).
CORE_SCATTER = (0.64, 0.73, 0.82, 0.91, 0.95)
GAP_SHARE = 0.75
REFERENCE_QUANTILE = 0.05


@dataclass
class Limits:
    """Heights and sizes that a branch has to meet."""

    cut: float
    scatter: float
    gap: float
    min_size: int

    @classmethod
    def of(cls, heights: np.ndarray, deep_split: int, cut_height: float | None, min_size: int) -> Limits:
        if not 0 <= deep_split < len(CORE_SCATTER):
            raise ValueError(f"deep_split is 0 to {len(CORE_SCATTER) - 1}, not {deep_split!r}")
        low, high = float(heights[max(1, round(len(heights) * REFERENCE_QUANTILE)) - 1]), float(heights[-1])
        cut = low + 0.99 * (high - low) if cut_height is None else min(cut_height, high)
        share = CORE_SCATTER[deep_split]
        return cls(cut, low + share * (cut - low), (1 - share) * GAP_SHARE * (cut - low), min_size)

    def core(self, genes: list[int]) -> tuple[int, ...]:
        """The genes of a branch that joined first: half the least size, and with the root of what is beyond that."""
        base, n = self.min_size / 2 + 1, len(genes)
        return tuple(genes[: int(base + (n - base) ** 0.5) if base < n else n])

    def loose(self, scatter: float, top: float) -> bool:
        return scatter > self.scatter or top - scatter < self.gap


@dataclass
class Branch:
    genes: list[int] = field(default_factory=list)
    size: int = 0
    basic: bool = True  # not made of branches that stay apart
    top: float | None = None  # where it met another branch
    absorbed: bool = False


class Walk:
    """One way up the tree with the scatters known so far; ``wanted`` holds the cores it would have liked to know."""

    def __init__(self, merges: np.ndarray, n: int, limits: Limits, known: dict[tuple, float]):
        self.limits, self.known, self.wanted = limits, known, set()
        self.branches: list[Branch] = []
        self.small: list[tuple[list[int], float]] = []  # genes and end of what was absorbed for its size
        at: dict[int, Branch] = {}
        for k, (a, b, height, _) in enumerate(merges):
            if height > limits.cut:
                break
            sides = [at.pop(int(x), int(x)) for x in (a, b)]
            at[n + k] = self.meet(*sides, float(height))
        self.roots = list(at.values())

    def scatter(self, genes: list[int]) -> float:
        core = self.limits.core(genes)
        if core not in self.known:
            self.wanted.add(core)
        return self.known.get(core, np.inf)

    def meet(self, a: Branch | int, b: Branch | int, height: float) -> Branch:
        if isinstance(a, int) and isinstance(b, int):
            self.branches.append(Branch([a, b], 2))
            return self.branches[-1]
        if isinstance(a, int) or isinstance(b, int):
            branch, gene = (b, a) if isinstance(a, int) else (a, b)
            branch.genes.append(gene)
            branch.size += 1
            return branch
        order = sorted((a, b), key=lambda x: x.size) if a.size != b.size else [b, a]
        fails = [x.basic and (x.size < self.limits.min_size or self.limits.loose(self.scatter(x.genes), height)) for x in order]
        if not any(fails):
            both = Branch([], a.size + b.size, basic=False)
            a.top = b.top = height
            self.branches.append(both)
            return both
        lost, kept = order if fails[0] else order[::-1]
        lost.top, lost.absorbed = height, True
        if lost.size < self.limits.min_size:
            self.small.append((list(lost.genes), height))
        kept.size += lost.size
        if kept.basic:
            kept.genes += lost.genes
        return kept

    def clusters(self) -> list[list[int]]:
        found = []
        for x in self.branches:
            if x.basic and not x.absorbed and x.size >= self.limits.min_size:
                scatter, top = self.scatter(x.genes), self.limits.cut if x.top is None else x.top
                if scatter < self.limits.scatter and top - scatter > self.limits.gap:
                    found.append(x.genes)
        return found

    def small_groups(self) -> list[list[int]]:
        """What only its size kept from being a cluster."""
        return [genes for genes, top in self.small if not self.limits.loose(self.scatter(genes), top)]


def core_scatters(tom: DataFrame, cores: list[tuple], genes: list[str], value: str = "tom") -> dict[tuple, float]:
    """Mean distance between the genes of each core."""
    rows = [(i, genes[x]) for i, core in enumerate(cores) for x in core]
    member = tom.sparkSession.createDataFrame(rows, "core int, gene string")
    pairs = member.withColumnRenamed("gene", "g1").join(member.withColumnRenamed("gene", "g2"), "core").where("g1 < g2")
    near = tom.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), F.col(value).alias("near"))
    sums = {r["core"]: r["near"] for r in pairs.join(near, ["g1", "g2"]).groupBy("core").agg(F.sum("near").alias("near")).collect()}
    return {core: 1 - sums.get(i, 0.0) / (len(core) * (len(core) - 1) / 2) for i, core in enumerate(cores)}


def branches(tom: DataFrame, genes: list[str], merges: np.ndarray, limits: Limits, value: str = "tom") -> tuple[list[list[int]], list[list[int]], list[int]]:
    """(clusters, small groups, top branch of each gene) of the tree."""
    known: dict[tuple, float] = {}
    while True:
        walk = Walk(merges, len(genes), limits, known)
        clusters, small = walk.clusters(), walk.small_groups()
        if not walk.wanted:
            break
        known |= core_scatters(tom, sorted(walk.wanted), genes, value)
    top: dict[int, int] = {}
    for k in range(len(merges) - 1, -1, -1):
        if merges[k, 2] <= limits.cut:
            top |= dict.fromkeys((int(merges[k, 0]), int(merges[k, 1])), top.get(len(genes) + k, k))
    root = [top.get(i, -1 - i) for i in range(len(genes))]  # a gene above the cut is a branch of its own
    return clusters, small, root


def assign_by_distance(tom: DataFrame, labels: DataFrame, cut_height: float, within_branch: bool = False, value: str = "tom") -> DataFrame:
    """(gene, cluster): clusters of ``labels`` (gene, cluster, small, root), 0 for none, with the genes without one sent to the nearest.

    Genes of a small group (``small`` above 0) go together, by the group's mean distance, or stay. ``within_branch`` leaves
    each gene the clusters below its own ``root``. The nearest is taken if its mean distance is below ``cut_height`` or
    the cluster's diameter, the largest mean distance of a member to the others. Ties go to the smaller number.
    """
    labels = keep(labels)
    links = tom.select(F.col("g1").alias("gene"), F.col("g2").alias("other"), F.col(value).alias("near"))
    links = links.unionAll(links.select(F.col("other").alias("gene"), F.col("gene").alias("other"), "near"))
    there = labels.where("cluster > 0").select(F.col("gene").alias("other"), F.col("cluster").alias("to"), F.col("root").alias("to_root"))
    met = links.join(there, "other").groupBy("gene", "to", "to_root").agg(F.sum("near").alias("near"))
    size = labels.where("cluster > 0").groupBy(F.col("cluster").alias("to")).agg(F.count("*").alias("size"))
    met = keep(met.join(size, "to").join(labels, "gene"))  # a row for each gene and cluster
    own = met.where("cluster = to").select("gene", "near")
    home = labels.where("cluster > 0").select("gene", F.col("cluster").alias("to")).join(own, "gene", "left").join(size, "to")
    diameter = home.groupBy("to").agg(F.max(1 - F.coalesce("near", F.lit(0.0)) / F.greatest(F.col("size") - 1, F.lit(1))).alias("diameter"))
    free = met.where("cluster = 0")
    if within_branch:
        free = free.where("root = to_root")
    alone = free.where("small = 0").select(F.col("gene").alias("who"), "to", (1 - F.col("near") / F.col("size")).alias("far"))
    groups = labels.where("cluster = 0 and small > 0").groupBy("small").agg(F.count("*").alias("n"))
    group = free.where("small > 0").groupBy("small", "to", "size").agg(F.sum("near").alias("near")).join(groups, "small")
    group = group.select("small", "to", (1 - F.col("near") / (F.col("size") * F.col("n"))).alias("far"))

    def nearest(far: DataFrame, by: str) -> DataFrame:
        best = far.groupBy(by).agg(F.min(F.struct("far", "to")).alias("b")).select(by, "b.far", "b.to").join(diameter, "to")
        return best.where(F.col("far") < F.greatest(F.col("diameter"), F.lit(cut_height))).select(by, F.col("to").alias(f"to_{by}"))

    out = labels.join(nearest(alone, "who"), F.col("gene") == F.col("who"), "left").join(nearest(group, "small"), "small", "left")
    return out.select("gene", F.when(F.col("cluster") > 0, F.col("cluster")).otherwise(F.coalesce("to_who", "to_small", F.lit(0))).alias("cluster"))


def hybrid_cut(tom: DataFrame, genes: list[str], merges: np.ndarray, deep_split: int = 4, cut_height: float | None = 0.995, min_size: int = 20, pam: bool = True, within_branch: bool = False, value: str = "tom") -> DataFrame:
    """(gene, module) of a tree (``clustering.tree``): M1.. by size, grey for what stays apart.

    ``cut_height`` None is 99 % of the range of heights; ``pam`` False leaves out the step by distance.
    """
    spark, schema = tom.sparkSession, "gene string, cluster int, small int, root int"
    if len(genes) < 2:
        return spark.createDataFrame([(g, "grey") for g in genes], "gene string, module string")
    limits = Limits.of(merges[:, 2], deep_split, cut_height, min_size)
    clusters, small, root = branches(tom, genes, merges, limits, value)
    label, group = np.zeros(len(genes), int), np.zeros(len(genes), int)
    for i, c in enumerate(sorted(clusters, key=min), 1):
        label[c] = i
    for i, c in enumerate(small, 1):
        group[c] = i
    labels = spark.createDataFrame([(g, int(label[i]), int(group[i]) if label[i] == 0 else 0, int(root[i])) for i, g in enumerate(genes)], schema)
    if pam and clusters:
        labels = keep(assign_by_distance(tom, labels, limits.cut, within_branch, value))
    sizes = labels.where("cluster > 0").groupBy("cluster").agg(F.count("*").alias("n"), F.min("gene").alias("first"))
    names = sizes.select("cluster", F.concat(F.lit("M"), F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("string")).alias("module"))  # a row for each module
    return labels.join(names, "cluster", "left").select("gene", F.coalesce("module", F.lit("grey")).alias("module"))
