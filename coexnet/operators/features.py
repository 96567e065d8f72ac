"""Feature selection, normalisation and pseudobulk on the long sparse matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_cells(expr: DataFrame) -> int:
    return expr.select("cell").distinct().count()


def gene_fraction(expr: DataFrame, n_cells: int, fraction: float = 0.05) -> DataFrame:
    """(gene, frac) of the genes that are above zero in at least ``fraction`` of all cells."""
    g = expr.groupBy("gene").agg((F.count_if(F.col("value") > 0) / F.lit(float(n_cells))).alias("frac"))
    return g.where(F.col("frac") >= fraction)


def gene_flagged(expr: DataFrame, flags: DataFrame, flag: str = "highly_variable", n_genes: int | None = None, place: str | None = None) -> DataFrame:
    """(gene) of the expressed genes that a (gene, flag) table marks; a null flag is no mark.

    With ``n_genes`` the first of them by the column ``place`` of ``flags``, nulls last, or by name if there is none.
    """
    marked = flags.where(F.coalesce(F.col(flag), F.lit(False)))
    if n_genes is None:
        return expr.select("gene").distinct().join(marked.select("gene"), "gene", "left_semi")
    at = marked.groupBy("gene").agg(F.min(F.col(place) if place else F.lit(0)).alias("at"))
    return at.join(expr.select("gene").distinct(), "gene", "left_semi").orderBy(F.col("at").asc_nulls_last(), "gene").limit(n_genes).select("gene")


def gene_cv2(expr: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """(gene, cv2) of the most variable genes: population variance over squared mean; absent zeros count."""
    n = F.lit(float(n_cells))
    mean = F.sum("value") / n
    g = expr.groupBy("gene").agg(mean.alias("mean"), (F.sum(F.col("value") * F.col("value")) / n).alias("square"))
    g = g.select("gene", ((F.col("square") - F.col("mean") ** 2) / (F.col("mean") ** 2 + 1e-8)).alias("cv2"))
    return g.orderBy(F.desc(F.round("cv2", 9)), F.desc("gene")).limit(n_genes)


def gene_custom(expr: DataFrame, genes: list[str]) -> DataFrame:
    """(gene, ord) of the wanted genes that exist, in the caller's order."""
    if not genes:
        raise ValueError("custom selection needs a list of genes")
    wanted = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(genes))], "gene string, ord int")
    return F.broadcast(wanted).join(expr.select("gene").distinct(), "gene", "left_semi")


def good_genes(expr: DataFrame, n_cells: int) -> DataFrame:
    """(gene, variance): sample variance above 1e-15 and no NaN."""
    n = F.lit(float(n_cells))
    g = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count_if(F.isnan("value")).alias("bad"))
    g = g.where("bad = 0").select("gene", ((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)).alias("variance"))
    return g.where("variance > 1e-15")


def log_normalize(expr: DataFrame, scale: float = 1e4) -> DataFrame:
    """(cell, gene, value): log1p of each count over its cell's total."""
    total = F.sum("value").over(Window.partitionBy("cell"))
    return expr.withColumn("total", total).select("cell", "gene", F.log1p(F.col("value") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")) * scale).alias("value"))


def pseudobulk(expr: DataFrame, cells: DataFrame, by: list[str], method: str = "mean") -> DataFrame:
    """(by..., gene, value, n_cells): sum, or mean over all cells of the group (absent values are zeros)."""
    if method not in ("mean", "sum"):
        raise ValueError(f"unknown method {method!r}")
    sizes = cells.groupBy(*by).agg(F.count("*").alias("n_cells"))
    sums = expr.join(cells.select("cell", *by), "cell").groupBy(*by, "gene").agg(F.sum("value").alias("total"))
    out = sums.join(sizes, by)
    value = F.col("total") / F.col("n_cells") if method == "mean" else F.col("total")
    return out.select(*by, "gene", value.alias("value"), "n_cells")


def min_cells_groups(cells: DataFrame, by: list[str], min_cells: int = 100) -> DataFrame:
    """(group, n_cells) of the groups with enough cells; the key joins the columns with '#'."""
    g = cells.groupBy(F.concat_ws("#", *(F.col(c).cast("string") for c in by)).alias("group")).agg(F.count("*").alias("n_cells"))
    return g.where(F.col("n_cells") >= min_cells)
