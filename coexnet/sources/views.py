"""Feature-by-observation views of the sample tables, and readers of matrix files.

A matrix is a long sparse table ``(cell, gene, value)``: zeros are absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense view: quantity by supplier (cell) and brand (gene)."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse view: quantity by customer (cell) and brand with type (gene)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("gene"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("cell", "gene").agg(F.sum("l_quantity").alias("value"))


def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense view: component (gene ``g00``...) of each vector (cell)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("i", "x"))
    return e.select("cell", F.concat(F.lit("g"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene"), F.col("x").cast("double").alias("value"))


def fixed_modules(genes: DataFrame) -> DataFrame:
    """(gene, module): a fixed assignment of the components, every eighth left out as grey."""
    dim = F.regexp_extract("gene", r"(\d+)", 1).cast("int")
    return genes.select("gene", F.when(dim % 8 == 7, "grey").otherwise(F.concat(F.lit("M"), (1 + dim % 8).cast("string"))).alias("module"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("cell"), "c_mktsegment", "n_regionkey", "c_acctbal")


def read_wide_matrix(spark: SparkSession, matrix: str, metadata: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(expr, cells) of a CSV with genes in rows and cells in columns, and a CSV of cell metadata.

    The metadata's key is ``cell``, else ``barcode``; cells in only one of the files are left out, those without counts stay.
    """
    wide = spark.read.csv(matrix, header=True, inferSchema=True)
    gene = wide.columns[0]
    cells = spark.read.csv(metadata, header=True, inferSchema=True)
    key = key or next((c for c in ("cell", "barcode") if c in cells.columns), None)
    if key is None:
        raise ValueError("metadata needs a column 'cell' or 'barcode'")
    cells = cells.withColumnRenamed(key, "cell").withColumn("cell", F.col("cell").cast("string"))
    long = wide.select(F.col(f"`{gene}`").alias("gene"), *(F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns[1:])).unpivot("gene", [f"`{c}`" for c in wide.columns[1:]], "cell", "value")
    expr = long.where((F.col("value") != 0) & F.col("value").isNotNull()).join(cells.select("cell"), "cell", "left_semi")
    return expr.select("cell", "gene", "value"), cells.where(F.col("cell").isin(*wide.columns[1:]))


def read_result_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Long tables of ``power_table.csv``, ``modules.csv``, ``kME.csv`` and ``MEs.csv`` (those that exist are read lazily)."""
    load = lambda n: spark.read.csv(f"{folder}/{n}.csv", header=True, inferSchema=True)
    power = load("power_table")
    names = {"Power": "power", "SFT.R.sq": "sft_r_sq", "truncated.R.sq": "truncated_r_sq", "mean.k.": "mean_k", "median.k.": "median_k", "max.k.": "max_k"}
    power = power.toDF(*(names.get(c, c.replace(".", "_")) for c in power.columns))
    modules = load("modules").withColumnRenamed("gene_name", "gene")
    kme = load("kME")
    kme = kme.toDF("gene", *(c.removeprefix("kME").lstrip("_") for c in kme.columns[1:]))
    kme = kme.unpivot("gene", [f"`{c}`" for c in kme.columns[1:]], "module", "kme")
    mes = load("MEs")
    rest = [c for c in mes.columns if c != "cell"]
    mes = mes.select(F.col("cell").cast("string").alias("cell"), *(F.col(f"`{c}`").cast("double") for c in rest)).unpivot("cell", [f"`{c}`" for c in rest], "module", "me")
    return {"power_table": power, "modules": modules, "kme": kme, "mes": mes}
