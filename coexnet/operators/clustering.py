"""Average linkage of a gene network, Ward linkage of square tables, and cuts of the tree.

The tree grows in rounds over the table of gene pairs: in each, all clusters
that are each other's nearest merge, and the pairs' summed similarities are added up by the
new clusters. Average linkage is reducible, so this is the tree that merging one
pair at a time gives (equal distances are told apart by the clusters' first genes). Ward's distance grows from the same
sums: that of centres is the mean square between two clusters less the squares within each. No task holds the square
of genes; cuts work on the merges, of which there is one less than genes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators import tree_cut
from coexnet.operators.correlation import pair_products
from coexnet.operators.rounds import keep


def average_linkage(d: np.ndarray) -> np.ndarray:
    """Merges (left, right, height, size) of UPGMA by nearest-neighbour chains, in order of height."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    chain: list[int] = []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(np.where(alive, d[a], np.inf)))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((min(a, b), max(a, b), d[a, b]))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        keep, gone = min(a, b), max(a, b)
        d[keep], d[:, keep] = new, new
        d[keep, keep] = np.inf
        alive[gone] = False
        d[gone], d[:, gone] = np.inf, np.inf
        size[keep] += size[gone]
    return in_order(merges, n)


def in_order(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """(left, right, height, size) in order of height, from merges of any two members of the clusters."""
    order = sorted(range(n - 1), key=lambda i: (merges[i][2], merges[i][0], merges[i][1]))
    label, count, out = np.arange(n), np.ones(2 * n - 1, int), np.zeros((n - 1, 4))
    root = {i: i for i in range(n)}
    for k, i in enumerate(order):
        a, b, h = merges[i]
        ta, tb = _top(label, a), _top(label, b)
        ra, rb = root[ta], root[tb]
        count[n + k] = count[ra] + count[rb]
        out[k] = min(ra, rb), max(ra, rb), h, count[n + k]
        label[tb] = ta
        root[ta] = n + k
    return out


def _top(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        i = label[i]
    return int(i)


def cut_static(merges: np.ndarray, n: int, height: float, min_size: int) -> np.ndarray:
    """Labels of the subtrees below ``height``, largest first; 0 for those with under ``min_size`` leaves."""
    label = np.arange(n)
    node = {i: i for i in range(n)}
    for k, (a, b, h, _) in enumerate(merges):
        if h > height:
            break
        ra, rb = _top(label, node[int(a)]), _top(label, node[int(b)])
        label[max(ra, rb)] = min(ra, rb)
        node[n + k] = min(ra, rb)
    tops = np.array([_top(label, i) for i in range(n)])
    names, inverse, count = np.unique(tops, return_inverse=True, return_counts=True)
    order = sorted((i for i in range(len(names)) if count[i] >= min_size), key=lambda i: (-count[i], names[i]))
    new = np.zeros(len(names), int)
    for r, i in enumerate(order, 1):
        new[i] = r
    return new[inverse]


def cut_gap(merges: np.ndarray, n: int, cut_height: float = 0.995, min_size: int = 20, min_gap: float = 0.5) -> np.ndarray:
    """Labels by walking the tree up: a branch ends as a cluster where it joins anything far above its core.

    Far is a share ``min_gap`` of the range of heights, or the cut height; the core is the lower half of the branch's
    own heights, ``min_size - 1`` at least. What joins a finished cluster later stays apart.
    """
    if not len(merges):
        return np.zeros(n, int)
    lowest, highest = float(np.quantile(merges[:, 2], 0.05)), min(cut_height, float(merges[-1, 2]))
    gap = min_gap * (highest - lowest)
    leaves: list[list[int]] = [[i] for i in range(n)]
    heights: list[list[float]] = [[] for _ in range(n)]
    clusters: list[list[list[int]]] = [[] for _ in range(n)]  # finished clusters below each node
    for a, b, h, _ in merges:
        done = []
        for x in (int(a), int(b)):
            done += clusters[x]
            if not clusters[x] and len(leaves[x]) >= max(2, min_size):
                core = sorted(heights[x])[: max(min_size - 1, len(heights[x]) // 2, 1)]
                if h > cut_height or h - float(np.mean(core)) >= gap:
                    done.append(leaves[x])
        leaves.append(leaves[int(a)] + leaves[int(b)])
        heights.append(heights[int(a)] + heights[int(b)] + [float(h)])
        clusters.append(done)
    found = clusters[-1] or ([leaves[-1]] if n >= min_size and merges[-1, 2] <= cut_height else [])
    out = np.zeros(n, int)
    for r, c in enumerate(sorted(found, key=lambda c: (-len(c), min(c))), 1):
        out[c] = r
    return out


def _distance(method: str) -> Column:
    """Of two clusters, from the sum ``s`` over their pairs, their sizes ``na``, ``nb`` and the sums ``wa``, ``wb`` within each."""
    s, na, nb = F.col("s"), F.col("na"), F.col("nb")
    if method == "average":
        return 1 - s / (na * nb)
    centres = s / (na * nb) - F.col("wa") / (na * na) - F.col("wb") / (nb * nb)
    return F.sqrt(F.round(2 * na * nb / (na + nb) * F.greatest(F.lit(0.0), centres), 12))


def tree(table: DataFrame, value: str = "tom", method: str = "average") -> tuple[list[str], np.ndarray]:
    """(genes in order of name, merges) of a table (g1, g2, value) of pairs.

    ``average``: linkage on ``1 - value``; pairs that are not listed are at distance 1. ``ward``: ``value`` is a squared Euclidean
    distance and every pair must be listed; squares of heights are rounded to 12 decimals, so that equal ones tie. Collects a row for each gene and for each merge.
    """
    if method not in ("average", "ward"):
        raise ValueError(f"unknown linkage {method!r}")
    spark = table.sparkSession
    ends = table.select(F.col("g1").alias("gene")).unionAll(table.select("g2")).distinct()
    named = keep(ends.withColumn("id", F.row_number().over(Window.orderBy("gene")) - 1))  # a row for each gene
    genes = [r["gene"] for r in named.orderBy("id").collect()]
    ids = lambda c, to: named.select(F.col("gene").alias(c), F.col("id").alias(to))
    pairs = table.join(ids("g1", "a"), "g1").join(ids("g2", "b"), "g2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(value).alias("s"))
    size, within = np.ones(len(genes), np.int64), np.zeros(len(genes))
    sides = {"n": 1.0} if method == "average" else {"n": 1.0, "w": 0.0}
    pairs = keep(pairs.select("a", "b", "s", *(F.lit(x).alias(c + e) for c, x in sides.items() for e in "ab")))
    if method == "ward" and pairs.count() != len(genes) * (len(genes) - 1) // 2:
        raise ValueError("Ward linkage needs each pair once")
    merges: list[tuple[int, int, float]] = []
    alive = set(range(len(genes)))
    while True:
        edges = pairs.withColumn("d", _distance(method)).withColumn("e", F.struct("d", "a", "b", "s"))
        near = edges.select(F.explode(F.array("a", "b")).alias("id"), "e").groupBy("id").agg(F.min("e").alias("e")).select("id", "e.*").collect()  # a row for each cluster
        chosen = Counter((r["a"], r["b"]) for r in near)
        found = [r for r in near if r["id"] == r["a"] and chosen[r["a"], r["b"]] == 2]  # two clusters that choose the same pair
        if not found:
            break
        for r in found:
            merges.append((r["a"], r["b"], float(r["d"])))
            size[r["a"]] += size[r["b"]]
            within[r["a"]] += within[r["b"]] + r["s"]
            alive.discard(r["b"])
        new = [(x, r["a"], float(size[r["a"]]), float(within[r["a"]])) for r in found for x in (r["a"], r["b"])]
        renamed = F.broadcast(spark.createDataFrame(new, "old int, new int, n double, w double"))  # at most a row for each cluster
        x = pairs
        for e in "ab":
            x = x.join(renamed.select(F.col("old").alias(e), F.col("new").alias("to"), *(F.col(c).alias(f"{c}_new") for c in sides)), e, "left")
            x = x.withColumns({e: F.coalesce("to", e), **{c + e: F.coalesce(f"{c}_new", c + e) for c in sides}}).drop("to", *(f"{c}_new" for c in sides))
        swap = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
        x = x.where("a <> b").select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), "s", *(swap(c + p, c + q).alias(c + p) for c in sides for p, q in ("ab", "ba")))
        pairs = keep(x.groupBy("a", "b").agg(F.sum("s").alias("s"), *(F.max(c + e).alias(c + e) for c in sides for e in "ab")))
    rest = sorted(alive)
    merges += [(rest[0], x, 1.0) for x in rest[1:]]  # clusters without a pair between them
    return genes, in_order(merges, len(genes)) if genes else np.zeros((0, 4))


def linkage(table: DataFrame, value: str = "tom", method: str = "average") -> DataFrame:
    """(step, left, right, height, size): leaves are numbered in order of gene name, merges after them."""
    rows = [(k, int(a), int(b), float(h), int(n)) for k, (a, b, h, n) in enumerate(tree(table, value, method)[1])]
    return table.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size int")


def row_distances(x: DataFrame, plan: str = "relational") -> DataFrame:
    """(g1, g2, square) of all g1 < g2: squared Euclidean distances between the rows of a matrix (gene, cell, value); absent and null values are zeros.

    By norms and products over shared cells, so a sparse matrix stays sparse until the square of its rows, which is the result.
    """
    x = x.select("cell", "gene", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    norm = x.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    both = norm.select(F.col("gene").alias("g1"), F.col("q").alias("q1")).join(norm.select(F.col("gene").alias("g2"), F.col("q").alias("q2")), F.col("g1") < F.col("g2"))
    square = F.col("q1") + F.col("q2") - 2 * F.coalesce("sxy", F.lit(0.0))
    return both.join(pair_products(x, plan), ["g1", "g2"], "left").select("g1", "g2", F.greatest(F.lit(0.0), square).alias("square"))


def leaf_order(table: DataFrame, value: str = "tom", method: str = "average") -> DataFrame:
    """(gene, place): the order of the tree's leaves from left to right."""
    genes, z = tree(table, value, method)
    return table.sparkSession.createDataFrame([(g, int(p)) for g, p in zip(genes, leaf_places(z, len(genes)), strict=True)], "gene string, place int")


def leaf_places(merges: np.ndarray, n: int) -> np.ndarray:
    """Each leaf's place from left to right: the leaves that stand before it, counted from the sizes of the branches."""
    size = lambda x: 1 if x < n else int(merges[x - n, 3])
    start = np.zeros(2 * n - 1 if n else 0, int)
    for k in range(len(merges) - 1, -1, -1):
        left, right = int(merges[k, 0]), int(merges[k, 1])
        start[left], start[right] = start[n + k], start[n + k] + size(left)
    return start[:n]


def dendrogram(tom: DataFrame, hang: float = 0.03, value: str = "tom") -> tuple[DataFrame, DataFrame]:
    """(gene, place) and (step, part, x0, y0, x1, y1): the order of leaves, and the left leg, bar and right leg that draw each merge.

    Leaves stand at whole numbers and hang a share of the largest height below their merge, not below 0; with a negative ``hang`` all reach 0.
    Works on the merges, a row less than genes.
    """
    spark = tom.sparkSession
    genes, z = tree(tom, value)
    n, place = len(genes), leaf_places(z, len(genes))
    x = np.zeros(n + len(z))
    x[:n] = place
    rows = []
    for k, (a, b, h, _) in enumerate(z):
        left, right = int(a), int(b)
        foot = lambda i: float(z[i - n, 2]) if i >= n else max(0.0, float(h - hang * z[-1, 2])) if hang >= 0 else 0.0  # noqa: B023, E731
        x[n + k] = (x[left] + x[right]) / 2
        rows += [(k, "left", float(x[left]), foot(left), float(x[left]), float(h)), (k, "bar", float(x[left]), float(h), float(x[right]), float(h)), (k, "right", float(x[right]), float(h), float(x[right]), foot(right))]
    return spark.createDataFrame([(g, int(p)) for g, p in zip(genes, place, strict=True)], "gene string, place int"), spark.createDataFrame(rows, "step int, part string, x0 double, y0 double, x1 double, y1 double")


def detect_modules(tom: DataFrame, method: str = "static", height: float = 0.8, cut_height: float | None = 0.995, min_size: int = 20, value: str = "tom", deep_split: int = 4, pam: bool = True, within_branch: bool = False) -> DataFrame:
    """(gene, module): M1.. by size, grey for what stays apart.

    ``hybrid`` cuts by shape and distance (``tree_cut``), once more at its own height if all is grey; ``static`` at ``height``; ``gap`` by one gap for all branches.
    """
    if method not in ("static", "gap", "hybrid"):
        raise ValueError(f"unknown cut {method!r}")
    genes, z = tree(tom, value)
    if method == "hybrid":
        cut = lambda at: keep(tree_cut.hybrid_cut(tom, genes, z, deep_split, at, min_size, pam, within_branch, value))
        found = cut(cut_height)
        return cut(None) if cut_height is not None and not found.where("module <> 'grey'").head(1) else found
    label = cut_static(z, len(genes), height, min_size) if method == "static" else cut_gap(z, len(genes), cut_height, min_size)
    return tom.sparkSession.createDataFrame([(g, f"M{x}" if x else "grey") for g, x in zip(genes, label, strict=True)], "gene string, module string")


def merge_close(modules: DataFrame, module_cor: DataFrame, cut_height: float = 0.2) -> DataFrame:
    """(gene, module): modules whose scores cluster within ``1 - cor <= cut_height`` take the smallest number among them.

    Takes the correlations of modules, a small square whatever the data.
    """
    rows = module_cor.toPandas()
    names = sorted(set(rows["m1"]) | set(rows["m2"]), key=lambda m: (int("".join(filter(str.isdigit, m)) or 0), m))
    if len(names) < 2:
        return modules.select("gene", "module")
    at = {m: i for i, m in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for a, b, c in rows[["m1", "m2", "cor"]].itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - (0 if np.isnan(c) else c)
    label = cut_static(average_linkage(d), len(names), cut_height, 1)
    first = {x: names[int(np.flatnonzero(label == x)[0])] for x in set(label)}
    new = modules.sparkSession.createDataFrame([(m, first[label[at[m]]]) for m in names], "module string, merged string")
    return modules.join(F.broadcast(new), "module", "left").select("gene", F.coalesce("merged", "module").alias("module"))


def merge_modules(modules: DataFrame, scores_of: Callable[[DataFrame], DataFrame], cor_of: Callable[[DataFrame], DataFrame], cut_height: float = 0.2, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(modules, their scores) after at most ``rounds`` merges of close modules; scores are computed anew of the merged modules.

    ``scores_of`` gives the scores of modules, ``cor_of`` the correlations of scores. Ends at the first round that merges none.
    """
    count = lambda m: m.select("module").distinct().count()
    scores, n = keep(scores_of(modules)), count(modules)
    for _ in range(rounds):
        merged = keep(merge_close(modules, cor_of(scores), cut_height))
        left = count(merged)
        if left == n:
            break
        modules, scores, n = merged, keep(scores_of(merged)), left
    return modules, scores
