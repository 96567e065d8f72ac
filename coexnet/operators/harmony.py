"""Batch correction by soft clusters (Korsunsky et al. 2019), in passes over a table of component scores.

The model (centroids and corrections of every module) has modules x clusters x (components + batches) numbers,
whatever the number of cells; it goes to the tasks, and sums of that size come back from each pass.
Memberships are updated for all cells at once, not in blocks of a twentieth; so that they do not swing,
the counts of batches in clusters that they are weighed by move only a part of the way in each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coexnet.operators.rounds import keep

SIGMA, THETA, RIDGE, STEP = 0.1, 2.0, 1.0, 0.3


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-12)


def memberships(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
    """Cells by clusters: nearness to the centres, less where a batch is over-represented in a cluster (``seen``: clusters by batches)."""
    r = np.exp(-2 * (1 - unit(z) @ centres.T) / SIGMA)
    if seen is not None:
        share = seen.sum(0) / max(seen.sum(), 1e-12)
        expected = seen.sum(1, keepdims=True) * share
        r = r * (((expected + 1) / (seen + 1)) ** THETA)[:, batch].T
    return r / np.maximum(r.sum(1, keepdims=True), 1e-300)


def batch_offsets(seen: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Clusters by batches by components: ridge regression of the scores on an intercept and the batches, the intercept left out."""
    k, b, d = sums.shape
    out = np.zeros_like(sums)
    for i in range(k):
        gram = np.zeros((b + 1, b + 1))
        gram[0, 0], gram[0, 1:], gram[1:, 0] = seen[i].sum(), seen[i], seen[i]
        gram[1:, 1:] = np.diag(seen[i] + RIDGE)
        if seen[i].sum() > 1e-9:
            out[i] = np.linalg.lstsq(gram, np.vstack([sums[i].sum(0), sums[i]]), rcond=None)[0][1:]
    return out


def _sums(table: DataFrame, shape: dict[str, tuple], work: Callable) -> dict[str, np.ndarray]:
    """``work(module, z, zc, batch)`` is an array for each slice of a module's cells; their sums over all cells."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for module, rows in pdf.groupby("module"):
                z, zc = np.array(rows["z"].tolist(), float), np.array(rows["zc"].tolist(), float)
                total[module] = total.get(module, 0) + work(module, z, zc, rows["b"].to_numpy())
        for module, x in total.items():
            yield pd.DataFrame({"module": module, "at": np.arange(x.size), "v": x.ravel()})

    rows = table.mapInPandas(part, "module string, at long, v double").groupBy("module", "at").agg(F.sum("v").alias("v")).toPandas()  # the size of the model
    out = {m: np.zeros(int(np.prod(s))) for m, s in shape.items()}
    for m, g in rows.groupby("module"):
        out[m][g["at"].to_numpy()] = g["v"].to_numpy()
    return {m: x.reshape(shape[m]) for m, x in out.items()}


def _nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and squared distance to it, on the unit sphere."""
    d = 2 - 2 * unit(z) @ centres.T
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(z)), at], 0.0)


def cost(table: DataFrame, centres: dict[str, np.ndarray]) -> dict[str, float]:
    """Sum of squared distances of a module's cells to their nearest centre."""
    got = _sums(table, {m: (1,) for m in centres}, lambda m, z, zc, b: np.array([_nearest(zc, centres[m])[1].sum()]))
    return {m: float(x[0]) for m, x in got.items()}


def reduce_centres(points: np.ndarray, weight: np.ndarray, k: int, most: int = 25) -> np.ndarray:
    """At most ``k`` unit centres of weighted points: each next one is the point with the largest weighted distance, then Lloyd's passes.

    The points are candidates, a few for each centre, whatever the number of cells.
    """
    chosen = [int(np.argmax(weight))]
    d = _nearest(points, points[chosen])[1]
    while len(chosen) < k and (weight * d).max() > 1e-12:
        chosen.append(int(np.argmax(weight * d)))
        d = np.minimum(d, _nearest(points, points[chosen[-1:]])[1])
    centres = points[chosen]
    for _ in range(most):
        at, _ = _nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, weight[:, None] * points)
        new = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-12, unit(total), centres)
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    return centres


def parallel_start(table: DataFrame, k: int, seed: str = "0", rounds: int = 3) -> dict[str, np.ndarray]:
    """First centres of every module by oversampling rounds (k-means||, Bahmani et al. 2012).

    The first candidate is the cell that is first by a hash; in each round a cell becomes one with a chance of 2k times its share of
    all squared distances, by a hash of cell and round, so about 2k a module and round reach the driver, whatever the number of cells.
    Candidates weigh as many cells as they are nearest to. Fewer than ``k`` centres come back where cells differ in fewer directions.
    """
    key = F.md5(F.concat_ws("#", F.lit(seed), F.col("cell").cast("string")))
    first = table.groupBy("module").agg(F.min(F.struct(key.alias("h"), F.col("cell").cast("string").alias("c"), F.col("zc").alias("z"))).alias("x")).collect()  # a row for each module
    found = {r["module"]: unit(np.array([r["x"]["z"]], float)) for r in first}
    for i in range(rounds):
        total = cost(table, found)
        draw = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(f"{seed}/{i}"), F.col("cell").cast("string"), "module")), 1, 12), 16, 10).cast("double") / float(1 << 48)

        def pick(batches: Iterator[pd.DataFrame], found=found, total=total) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for module, rows in pdf.groupby("module"):
                    z = np.array(rows["zc"].tolist(), float)
                    d = _nearest(z, found[module])[1]
                    taken = (rows["draw"].to_numpy(float) * total[module] < 2 * k * d) & (d > 1e-12)
                    yield pd.DataFrame({"module": rows["module"].to_numpy()[taken], "cell": rows["cell"].to_numpy()[taken], "z": pd.Series(list(unit(z[taken])), dtype=object)})

        new = sorted(table.select("module", F.col("cell").cast("string").alias("cell"), "zc", draw.alias("draw")).mapInPandas(pick, "module string, cell string, z array<double>").collect(), key=lambda r: (r["module"], r["cell"]))
        for m in found:
            more = [r["z"] for r in new if r["module"] == m]
            found[m] = np.vstack([found[m], np.array(more, float)]) if more else found[m]
    weight = _sums(table, {m: (len(c),) for m, c in found.items()}, lambda m, z, zc, b: np.bincount(_nearest(zc, found[m])[0], minlength=len(found[m])).astype(float))
    return {m: reduce_centres(c, weight[m], k) for m, c in found.items()}


def hash_start(table: DataFrame, k: int, n: int, seed: str = "0") -> dict[str, np.ndarray]:
    """First centres of every module: its first ``k`` cells in the order of a hash."""
    key = F.md5(F.concat_ws("#", F.lit(seed), "cell"))
    near = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) < min(1.0, (4 * k + 40) / n)  # about 4k + 40 cells
    first = table.where(near).groupBy("module").agg(F.slice(F.array_sort(F.collect_list(F.struct(key.alias("h"), F.col("cell").cast("string").alias("c"), "z"))), 1, k).alias("top")).collect()
    return {r["module"]: unit(np.array([x["z"] for x in r["top"]], float)) for r in first}


def harmony(scores: DataFrame, cells: DataFrame, batch: list[str], rounds: int = 5, inner: int = 5, max_clusters: int = 100, seed: str = "0", tolerance: float = 1e-4, start: str = "hash") -> DataFrame:
    """(cell, module, z): scores (cell, module, z array) with the batches' offsets within soft clusters taken out.

    There are a tenth as many clusters as cells, ``max_clusters`` at most; their first centres are cells in the order of a hash, or with
    ``start="parallel"`` found by ``parallel_start`` in seven more passes.
    A null batch is a batch of its own; batches are the combinations of all columns. Rounds end early where centres move by less than ``tolerance``.
    With a single batch the scores come back as they are.
    """
    if start not in ("hash", "parallel"):
        raise ValueError(f"unknown start {start!r}")
    label = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in batch))
    named = cells.select("cell", label.alias("label"))
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each batch
    if len(sizes) < 2:
        return scores.select("cell", "module", "z")
    n, n_batches = sum(sizes.values()), len(sizes)
    ids = scores.sparkSession.createDataFrame([(x, i) for i, x in enumerate(sorted(sizes))], "label string, b int")
    table = keep(scores.join(named.join(ids, "label").select("cell", "b"), "cell").select("cell", "module", "z", F.col("z").alias("zc"), "b"))
    k = max(2, min(round(n / 10), max_clusters))
    centres = parallel_start(table, k, seed) if start == "parallel" else hash_start(table, k, n, seed)
    counted: dict[str, np.ndarray] = {m: None for m in centres}

    def gather(use_original: bool, y: dict, seen: dict) -> tuple[dict, dict]:
        shape = {m: (len(c), n_batches, c.shape[1] + 1) for m, c in y.items()}

        def work(module: str, z: np.ndarray, zc: np.ndarray, b: np.ndarray) -> np.ndarray:
            r = memberships(zc, b, y[module], seen[module])
            x = np.hstack([z if use_original else unit(zc), np.ones((len(z), 1))])
            return np.stack([r[b == i].T @ x[b == i] for i in range(n_batches)], 1)

        got = _sums(table, shape, work)
        return {m: x[..., :-1] for m, x in got.items()}, {m: x[..., -1] for m, x in got.items()}

    for _ in range(rounds):
        moved = 0.0
        for _ in range(inner):
            sums, seen = gather(False, centres, counted)
            new = {m: unit(s.sum(1)) for m, s in sums.items()}
            step = max(float(np.abs(new[m] - centres[m]).max()) for m in new)
            counted = {m: x if counted[m] is None else counted[m] + STEP * (x - counted[m]) for m, x in seen.items()}
            centres, moved = new, max(moved, step)
            if step < tolerance:
                break
        sums, seen = gather(True, centres, counted)
        model = {m: (centres[m], counted[m], batch_offsets(seen[m], sums[m])) for m in centres}

        def correct(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for module, rows in pdf.groupby("module"):
                    y, o, w = model[module]
                    z, zc, b = np.array(rows["z"].tolist(), float), np.array(rows["zc"].tolist(), float), rows["b"].to_numpy()
                    r = memberships(zc, b, y, o)
                    fixed = z - np.einsum("ik,ikd->id", r, w[:, b].transpose(1, 0, 2)) if len(z) * w.shape[0] * w.shape[2] < 1 << 24 else z - np.stack([r[i] @ w[:, b[i]] for i in range(len(z))])
                    yield rows.assign(zc=list(fixed))

        table = keep(table.mapInPandas(correct, table.schema))
        if moved < tolerance:
            break
    return table.select("cell", "module", F.col("zc").alias("z"))


def harmony_consensus(scores: DataFrame, cells: DataFrame, batch: list[str], n_runs: int = 5, **how) -> DataFrame:
    """(cell, module, z): mean of the corrections from ``n_runs`` different first centres."""
    runs = [harmony(scores, cells, batch, seed=str(i), **how) for i in range(n_runs)]
    out = runs[0]
    for x in runs[1:]:
        out = out.unionAll(x)
    at = out.select("cell", "module", F.posexplode("z").alias("i", "v")).groupBy("cell", "module", "i").agg(F.avg("v").alias("v"))
    return at.groupBy("cell", "module").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("z"))
