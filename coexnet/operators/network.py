"""Soft thresholds, adjacency, connectivity, scale-free fit and topological overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.correlation import pair_products

POWERS = (*range(1, 11), *range(12, 31, 2))


def similarity(cor: Column, network: str = "signed") -> Column:
    if network == "signed":
        return (1 + cor) / 2
    if network == "unsigned":
        return F.abs(cor)
    if network == "signed hybrid":
        return F.greatest(cor, F.lit(0.0))
    raise ValueError(f"unknown network type {network!r}")


def adjacency(pairs: DataFrame, power: float, network: str = "signed") -> DataFrame:
    """(g1, g2, adj) from (g1, g2, cor)."""
    return pairs.select("g1", "g2", F.pow(similarity(F.col("cor"), network), F.lit(float(power))).alias("adj"))


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """(i, j, value) in both directions."""
    ends = F.explode(F.array(F.struct(F.col("g1").alias("i"), F.col("g2").alias("j")), F.struct(F.col("g2").alias("i"), F.col("g1").alias("j"))))
    return pairs.select(ends.alias("e"), value).select("e.i", "e.j", value)


def degrees(adj: DataFrame) -> DataFrame:
    """(gene, k): summed adjacency."""
    return both_ways(adj, "adj").groupBy(F.col("i").alias("gene")).agg(F.sum("adj").alias("k"))


def powered_degrees(pairs: DataFrame, powers=POWERS, network: str = "signed") -> DataFrame:
    """(power, gene, k) for all powers in one pass over the pairs."""
    s = pairs.select("g1", "g2", F.greatest(similarity(F.col("cor"), network), F.lit(1e-300)).alias("s"))
    each = both_ways(s, "s").select("i", "s", F.explode(F.array(*(F.lit(int(p)) for p in powers))).alias("power"))
    return each.groupBy("power", F.col("i").alias("gene")).agg(F.sum(F.pow("s", F.col("power").cast("double"))).alias("k"))


def scale_free_bins(k: DataFrame, n_breaks: int = 10) -> DataFrame:
    """(power, bin, dk, p_dk, n): mean connectivity and share of genes in equal-width bins; empty bins take their midpoint."""
    span = k.groupBy("power").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) / n_breaks
    place = F.coalesce(F.least(F.lit(n_breaks - 1), F.greatest(F.lit(0), F.ceil(F.round((F.col("k") - F.col("lo")) / width, 9)).cast("int") - 1)), F.lit(0))
    held = k.join(F.broadcast(span), "power").groupBy("power", place.alias("bin")).agg(F.avg("k").alias("mean"), F.count("*").alias("c"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_breaks - 1))).alias("bin"))
    out = grid.join(held, ["power", "bin"], "left")
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 0.5) / n_breaks
    return out.select("power", "bin", F.when(F.coalesce("mean", F.lit(0.0)) == 0, middle).otherwise(F.col("mean")).alias("dk"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("p_dk"), "n")


def scale_free_fit(k: DataFrame, n_breaks: int = 10, remove_first: bool = False) -> DataFrame:
    """(power, sft_r_sq, slope, truncated_r_sq) of log10 p(k) on log10 k, and on log10 k with k; zeros below four genes.

    ``remove_first`` leaves the bin of the least connectivity out of both fits; with under three bins left all are zeros.

    The second fit solves its normal equations on centred sums.
    """
    bins = scale_free_bins(k, n_breaks)
    b = (bins.where("bin > 0") if remove_first and n_breaks > 1 else bins).select("power", "n", F.log10(F.greatest("dk", F.lit(1e-9))).alias("x"), F.log10(F.col("p_dk") + 1e-9).alias("y"))
    b = b.withColumn("z", F.pow(F.lit(10.0), "x"))
    mean = b.groupBy("power").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    c = b.join(F.broadcast(mean), "power").select("power", "n", *((F.col(v) - F.col(f"m{v}")).alias(v) for v in "xyz"))
    s = c.groupBy("power").agg(F.first("n").alias("n"), F.count("*").alias("m"), *(F.sum(F.col(a) * F.col(d)).alias(a + d) for a, d in ("xx", "yy", "zz", "xy", "xz", "zy")))
    slope = F.coalesce(F.col("xy") / F.nullif("xx", F.lit(0.0)), F.lit(0.0))
    r2 = F.coalesce(F.greatest(F.lit(0.0), slope * F.col("xy") / F.nullif("yy", F.lit(0.0))), F.lit(0.0))
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    explained = ((F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) * F.col("xy") + (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) * F.col("zy")) / det
    adjusted = 1 - (1 - explained / F.nullif("yy", F.lit(0.0))) * (F.col("m") - 1) / (F.col("m") - 3)
    few = (F.col("n") < 4) | (F.col("m") < 3)
    zero = lambda e: F.when(few, 0.0).otherwise(e)
    return s.select("power", zero(r2).alias("sft_r_sq"), zero(slope).alias("slope"), zero(F.greatest(F.lit(0.0), F.coalesce(adjusted, F.lit(0.0)))).alias("truncated_r_sq"))


def power_table(pairs: DataFrame, powers=POWERS, network: str = "signed") -> DataFrame:
    """(power, sft_r_sq, slope, truncated_r_sq, mean_k, median_k, max_k)."""
    k = powered_degrees(pairs, powers, network)
    stats = k.groupBy("power").agg(F.avg("k").alias("mean_k"), F.median("k").alias("median_k"), F.max("k").alias("max_k"))
    return scale_free_fit(k).join(stats, "power")


def select_power(table: DataFrame, least: float = 0.85) -> int:
    """The first power whose fit reaches ``least``, else the best one. The table has a row per power."""
    rows = sorted(table.select("power", "sft_r_sq").collect())
    return next((r["power"] for r in rows if r["sft_r_sq"] >= least), max(rows, key=lambda r: r["sft_r_sq"])["power"])


def topological_overlap(adj: DataFrame, denominator: str = "min", plan: str = "relational") -> DataFrame:
    """(g1, g2, tom): shared and direct adjacency over the smaller (or larger) connectivity.

    Shared adjacency is the all-pairs product of the adjacency's rows, so it has the same two plans as the
    correlation; the relational one costs the cube of the genes, the blocked one suits more than about 150.
    """
    links = both_ways(adj, "adj")
    shared = pair_products(links.select(F.col("j").alias("cell"), F.col("i").alias("gene"), F.col("adj").alias("value")), plan)
    k = links.groupBy("i").agg(F.sum("adj").alias("k"))
    out = adj.join(shared, ["g1", "g2"], "left").join(k.select(F.col("i").alias("g1"), F.col("k").alias("k1")), "g1").join(k.select(F.col("i").alias("g2"), F.col("k").alias("k2")), "g2")
    pick = F.least if denominator == "min" else F.greatest
    tom = (F.coalesce("sxy", F.lit(0.0)) + F.col("adj")) / F.greatest(pick("k1", "k2") + 1 - F.col("adj"), F.lit(1e-6))
    return out.select("g1", "g2", F.least(F.lit(1.0), F.greatest(F.lit(0.0), tom)).alias("tom"))


def palette(modules: DataFrame) -> DataFrame:
    """(module, color): one colour name per module in natural order; grey stays grey, and so does what exceeds the list."""
    n = F.regexp_extract("module", r"(\d+)", 1).try_cast("int")
    named = modules.where("module <> 'grey'").select("module").distinct().withColumn("r", F.row_number().over(Window.orderBy(n, "module")))
    color = F.coalesce(F.try_element_at(F.array(*map(F.lit, COLORS)), F.col("r").cast("int")), F.lit("grey"))
    grey = modules.where("module = 'grey'").select("module").distinct().withColumn("color", F.lit("grey"))
    return named.select("module", color.alias("color")).unionAll(grey)


def color_of(module, colors: dict[str, str]):
    """The colour of a module for plots; ``#0072B2`` if it has none."""
    known = F.create_map(*(F.lit(x) for kv in colors.items() for x in kv)) if colors else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, module), F.lit("#0072B2"))


#: Names of module colours (fixed values).
COLORS = (
    "turquoise", "blue", "brown", "yellow", "green", "red", "black", "pink", "magenta", "purple", "greenyellow", "tan", "cyan", "salmon", "skyblue", "gold", "violet", "orange", "midnightblue", "lightcyan", "saddlebrown", "darkolivegreen",
    "coral", "orchid", "ivory", "darksalmon", "aquamarine", "lightsteelblue", "navajowhite", "beige", "limegreen", "darkturquoise", "khaki", "darkred", "darkmagenta", "chocolate", "crimson", "darkviolet", "powderblue", "seagreen",
    "forestgreen", "slategray", "darkgoldenrod", "indianred", "mediumpurple", "thistle", "plum", "mistyrose", "darkblue", "lightpink", "burlywood", "lightgoldenrod", "paleturquoise", "springgreen", "olivedrab", "sienna", "lightskyblue",
    "peachpuff", "steelblue", "firebrick", "cadetblue", "rosybrown", "chocolate1", "palevioletred",
)
