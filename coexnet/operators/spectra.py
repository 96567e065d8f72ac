"""Leading components of many matrices at once, by block Lanczos in passes over packed rows.

A module's matrix has a row for each cell and a column for each of its genes. A pass multiplies the matrix and its
transpose with a block of a few vectors for each module: every task adds up a vector for each gene over its cells. Only genes times the block's
width come to the driver, which keeps the blocks orthogonal and solves the small projected problem (Rayleigh-Ritz); neither
the square of a module's genes nor a module's cells ever meet in one place. Residuals come from the products that are there
already, so it is known when to stop. A module with no more genes than all blocks together is solved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.rounds import keep

OVERSAMPLE, TOLERANCE, MOST_PASSES = 3, 1e-9, 200


def _pass(vectors: np.ndarray, zero: np.ndarray, owner: np.ndarray):
    """Sums over rows of (module, genes, values): ``X' (X v)`` by gene for what is present, and the summed ``X v`` of each module."""
    n, width = vectors.shape
    modules = int(owner.max()) + 1
    rest = np.stack([np.bincount(owner, zero * vectors[:, k], modules) for k in range(width)], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gene, by_module, rows = np.zeros((n, width)), np.zeros((modules, width)), np.zeros(modules)
        for b in batches:
            if not b.num_rows:
                continue
            m, genes, values = b.column("m").to_numpy(), b.column("genes"), b.column("values").flatten().to_numpy()
            at = genes.flatten().to_numpy()
            size = np.diff(genes.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            for k in range(width):
                u = np.bincount(row, values * vectors[at, k], b.num_rows) + rest[m, k]
                by_gene[:, k] += np.bincount(at, values * u[row], n)
                by_module[:, k] += np.bincount(m, u, modules)
            rows += np.bincount(m, minlength=modules)
        if rows.any():
            some = np.flatnonzero(by_gene.any(1))
            kind = np.concatenate([np.zeros(len(some), int), np.ones(modules, int)])
            at = np.concatenate([some, np.arange(modules)])
            out = np.vstack([by_gene[some], by_module])
            count = np.concatenate([np.zeros(len(some)), rows])
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(count), *(pa.array(out[:, k].copy()) for k in range(width))], names=["kind", "at", "rows", *(f"w{k}" for k in range(width))])

    return work


class _Krylov:
    """One module's blocks on the driver."""

    def __init__(self, n: int, width: int, want: int):
        self.want = min(want, n)
        start = np.random.default_rng(n).normal(size=(n, min(n, width)))
        self.basis = [np.linalg.qr(start)[0]]
        self.products: list[np.ndarray] = []
        self.vectors: np.ndarray | None = None

    def feed(self, product: np.ndarray) -> None:
        """Takes the product of the last block; ``vectors`` is set once they have converged."""
        self.products.append(product)
        q, a = np.hstack(self.basis), np.hstack(self.products)
        h = q.T @ a
        value, y = np.linalg.eigh((h + h.T) / 2)
        value, y = value[::-1][: self.want], y[:, ::-1][:, : self.want]
        left = a @ y - (q @ y) * value
        new = product - q @ (q.T @ product)
        new -= q @ (q.T @ new)  # once more, for rounding
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        u = u[:, s > 1e-10 * max(abs(value[0]), 1e-300)]
        full = q.shape[1] + u.shape[1] > len(q)
        if full:
            u = u[:, : len(q) - q.shape[1]]
        if not u.shape[1] or np.linalg.norm(left, axis=0).max() <= TOLERANCE * max(abs(value[0]), 1e-300):
            self.vectors = q @ y
        else:
            self.basis.append(u)


def leading(x: DataFrame, zeros: DataFrame, modules: DataFrame, n_rows: int, n_components: int = 1) -> DataFrame:
    """(module, gene, component, loading): the first right singular vectors of each module's matrix, their largest entry positive.

    ``x`` is (cell, gene, value) less what an absent value is, which ``zeros`` (gene, zero) tells; ``n_rows`` counts all cells.
    Collects a row for each gene and pass.
    """
    spark = x.sparkSession
    named = modules.select("gene", "module").join(zeros, "gene")
    numbered = keep(named.withColumns({"id": F.row_number().over(Window.orderBy("module", "gene")) - 1, "m": F.dense_rank().over(Window.orderBy("module")) - 1}))  # a row for each gene
    genes = numbered.orderBy("id").collect()
    schema = "module string, gene string, component int, loading double"
    if not genes:
        return spark.createDataFrame([], schema)
    owner, zero = np.array([g["m"] for g in genes]), np.array([g["zero"] for g in genes], float)
    packed = x.join(numbered.select("gene", "id", "m"), "gene").groupBy("m", "cell").agg(F.collect_list(F.struct("id", "value")).alias("v"))
    packed = keep(packed.select("m", F.col("v.id").alias("genes"), F.col("v.value").alias("values")))
    of = [np.flatnonzero(owner == m) for m in range(owner.max() + 1)]
    spaces = [_Krylov(len(g), n_components + OVERSAMPLE, n_components) for g in of]
    for _ in range(MOST_PASSES):
        todo = [m for m, s in enumerate(spaces) if s.vectors is None]
        if not todo:
            break
        width = max(spaces[m].basis[-1].shape[1] for m in todo)
        v = np.zeros((len(genes), width))
        for m in todo:
            v[of[m], : spaces[m].basis[-1].shape[1]] = spaces[m].basis[-1]
        names = [f"w{k}" for k in range(width)]
        sums = packed.mapInArrow(_pass(v, zero, owner), "kind int, at int, rows double, " + ", ".join(f"{c} double" for c in names))
        got = sums.groupBy("kind", "at").agg(F.sum("rows").alias("rows"), *(F.sum(c).alias(c) for c in names)).collect()
        w, total = np.zeros((len(genes), width)), np.zeros((len(of), width))
        rest = np.stack([np.bincount(owner, zero * v[:, k], len(of)) for k in range(width)], 1)
        met = np.zeros(len(of))
        for r in got:
            row = [r[c] for c in names]
            if r["kind"]:
                total[r["at"]], met[r["at"]] = row, r["rows"]
            else:
                w[r["at"]] = row
        total += (n_rows - met)[:, None] * rest  # cells without a value of the module
        w += zero[:, None] * total[owner]
        for m in todo:
            spaces[m].feed(w[of[m], : spaces[m].basis[-1].shape[1]])
    else:
        raise RuntimeError(f"no convergence after {MOST_PASSES} passes")
    rows = []
    for m, s in enumerate(spaces):
        signed = s.vectors * np.where(s.vectors[np.abs(s.vectors).argmax(0), np.arange(s.want)] >= 0, 1, -1)
        rows += [(genes[g]["module"], genes[g]["gene"], k, float(signed[i, k])) for i, g in enumerate(of[m]) for k in range(s.want)]
    return spark.createDataFrame(rows, schema)


def embed(features: DataFrame, n_components: int = 2) -> DataFrame:
    """(gene, c0, c1, ..): places of genes by the leading components of their centred features (gene, hub, tom), the linear map in place of a neighbour embedding.

    Absent features are 0; a component's largest loading is positive.
    """
    x = features.select(F.col("gene").alias("cell"), F.col("hub").alias("gene"), F.col("tom").alias("value"))
    n = x.select("cell").distinct().count()
    zeros = x.groupBy("gene").agg((-F.sum("value") / F.lit(float(n))).alias("zero"))
    loads = keep(leading(x, zeros, zeros.select("gene", F.lit("all").alias("module")), n, n_components))
    rest = loads.join(zeros, "gene").groupBy("component").agg(F.sum(F.col("zero") * F.col("loading")).alias("rest"))  # a row for each component
    place = x.join(loads, "gene").groupBy("cell", "component").agg(F.sum(F.col("value") * F.col("loading")).alias("s")).join(rest, "component")
    wide = place.groupBy(F.col("cell").alias("gene")).pivot("component", list(range(n_components))).agg(F.first(F.col("s") + F.col("rest")))
    return wide.select("gene", *(F.col(f"`{k}`").alias(f"c{k}") for k in range(n_components)))
