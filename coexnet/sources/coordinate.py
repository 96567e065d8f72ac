"""Coordinate matrices (MatrixMarket) as long sparse tables, read in splits.

Lines are read by Spark's text source, from any store it reads and in as many parts as the file's blocks (a compressed file is
one). Only the banner and the line of sizes, which stand at the start of the first block, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS, SYMMETRIES = ("real", "double", "integer", "pattern"), ("general", "symmetric")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, block, id): the lines that aren't empty; ``id`` grows with the place in a block."""
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return lines.where("line <> ''")


def read_names(spark: SparkSession, path: str, column: int = 0, header: bool = False) -> DataFrame:
    """(place, name): the given column of a tab-separated file, places from 1; only counts of the file's parts are put in order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id")).where("value <> ''")
    rows = lines.select(F.split("value", "\t")[column].alias("name"), F.shiftright("id", 33).alias("part"), "id")
    before = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    placed = rows.join(before, "part").select((F.col("before") + inside - int(header)).alias("place"), "name")
    return placed.where("place > 0")


def read_coordinate_matrix(spark: SparkSession, path: str, genes: str, cells: str, genes_in_rows: bool = True, gene_column: int = 0, cell_column: int = 0, check: bool = True) -> DataFrame:
    """(cell, gene, value) of the entries other than 0 of a MatrixMarket file, with the names of a file each for genes and cells.

    Comments may stand before the sizes and among the entries. Entries of equal place are added up. Errors: no coordinate banner, complex or
    skew values, an entry that isn't numbers or lies outside the sizes, other numbers of names than the sizes tell and, with
    ``check``, another number of entries.
    """
    lines = _lines(spark, path)
    start = lines.where("block = 0")
    first = start.orderBy("id").limit(1).collect()
    banner = first[0]["line"].lower().split() if first else []
    if banner[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(banner) < 5:
        raise ValueError(f"{path} is no coordinate matrix")
    field, symmetry = banner[3:5]
    if field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"matrices of {field} {symmetry} entries are not read")
    sizes = start.where(~F.startswith("line", F.lit("%"))).orderBy("id").limit(1).collect()
    told = sizes[0]["line"].split() if sizes else []
    if len(told) != 3 or not all(x.isdigit() for x in told):
        raise ValueError(f"{path} has no line of sizes")
    n_rows, n_columns, n_entries = map(int, told)
    names = []
    for kind, file, column, n in (("genes", genes, gene_column, n_rows if genes_in_rows else n_columns), ("cells", cells, cell_column, n_columns if genes_in_rows else n_rows)):
        names.append(read_names(spark, file, column))
        if (found := names[-1].count()) != n:
            raise ValueError(f"{found} names of {kind} for a size of {n}")
    entries = lines.where(~F.startswith("line", F.lit("%")) & ~((F.col("block") == 0) & (F.col("id") == sizes[0]["id"])))
    if check and (found := entries.count()) != n_entries:
        raise ValueError(f"{found} entries where {n_entries} are told")
    part = F.split(F.trim("line"), r"\s+")
    value = F.lit(1.0) if field == "pattern" else F.get(part, F.lit(2)).try_cast("double")
    x = entries.select(F.get(part, F.lit(0)).try_cast("long").alias("i"), F.get(part, F.lit(1)).try_cast("long").alias("j"), value.alias("value"), "line")
    good = F.coalesce(F.col("i").between(1, n_rows) & F.col("j").between(1, n_columns) & F.col("value").isNotNull(), F.lit(False))
    x = x.select(F.when(good, F.col("i")).otherwise(F.raise_error(F.concat(F.lit("bad entry: "), "line"))).alias("i"), "j", "value")
    if symmetry == "symmetric":
        x = x.unionAll(x.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    gene, cell = ("i", "j") if genes_in_rows else ("j", "i")
    x = x.where("value <> 0").groupBy("i", "j").agg(F.sum("value").alias("value")).where("value <> 0")
    x = x.join(names[0].select(F.col("place").alias(gene), F.col("name").alias("gene")), gene).join(names[1].select(F.col("place").alias(cell), F.col("name").alias("cell")), cell)
    return x.select("cell", "gene", "value")
