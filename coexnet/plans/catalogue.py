"""Queries over the sample tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coexnet.functions import stats
from coexnet.operators import analysis, boosting, clustering, correlation, features, metacells, modules, network, plotdata, projection, regulation, spectra, tree_cut
from coexnet.operators.rounds import keep
from coexnet.sources import views
from coexnet.streaming import moments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL fragments ------------------------------------------------------------

SUP = "sup AS (SELECT l_suppkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CNT = "cnt AS (SELECT o_custkey AS cell, p_brand || '/' || p_type AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
EMB = "emb AS (SELECT vec_id AS cell, 'g' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS gene, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
FIX = "fix AS (SELECT DISTINCT gene, CASE WHEN CAST(substr(gene, 2) AS INT) % 8 = 7 THEN 'grey' ELSE 'M' || (1 + CAST(substr(gene, 2) AS INT) % 8) END AS module FROM emb)"
MES = "mes AS (SELECT cell, module, sum(value) / max(size) AS me FROM emb JOIN (SELECT *, count(*) OVER (PARTITION BY module) AS size FROM fix WHERE module <> 'grey') USING (gene) GROUP BY 1, 2)"


def pairs_sql(view: str, name: str = "pairs") -> str:
    return f"""n AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM {view}),
m AS (SELECT gene, sum(value) AS s, sum(value * value) AS ss FROM {view} GROUP BY gene),
xy AS (SELECT a.gene AS g1, b.gene AS g2, sum(a.value * b.value) AS sxy FROM {view} a JOIN {view} b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2),
{name} AS (SELECT a.gene AS g1, b.gene AS g2, coalesce((n * coalesce(sxy, 0) - a.s * b.s) / nullif(sqrt(greatest((n * a.ss - a.s * a.s) * (n * b.ss - b.s * b.s), 0)), 0), 0) AS cor
  FROM m a JOIN m b ON a.gene < b.gene CROSS JOIN n LEFT JOIN xy ON xy.g1 = a.gene AND xy.g2 = b.gene)"""


def adj_sql(power: int = 6, network_sim: str = "(1 + cor) / 2") -> str:
    return f"adj AS (SELECT g1, g2, power({network_sim}, {power}) AS adj FROM pairs), lnk AS (SELECT g1 AS i, g2 AS j, adj FROM adj UNION ALL SELECT g2, g1, adj FROM adj)"


DEG = "deg AS (SELECT i AS gene, sum(adj) AS k FROM lnk GROUP BY 1)"


def tom_sql(pick: str = "least") -> str:
    return f"""{DEG}, two AS (SELECT a.i AS g1, b.j AS g2, sum(a.adj * b.adj) AS s FROM lnk a JOIN lnk b ON a.j = b.i AND a.i < b.j GROUP BY 1, 2),
tom AS (SELECT a.g1, a.g2, least(1.0, greatest(0.0, (coalesce(s, 0) + adj) / greatest({pick}(k1.k, k2.k) + 1 - adj, 1e-6))) AS tom
  FROM adj a LEFT JOIN two t ON t.g1 = a.g1 AND t.g2 = a.g2 JOIN deg k1 ON k1.gene = a.g1 JOIN deg k2 ON k2.gene = a.g2)"""


KME = """gs AS (SELECT gene, count(*) AS n, sum(value) AS sx, sum(value * value) AS sxx FROM emb GROUP BY 1),
ms AS (SELECT module, sum(me) AS sy, sum(me * me) AS syy FROM mes GROUP BY 1),
kme AS (SELECT gene, module, coalesce((max(n) * sum(value * me) - max(sx) * max(sy)) / nullif(sqrt(greatest((max(n) * max(sxx) - max(sx) * max(sx)) * (max(n) * max(syy) - max(sy) * max(sy)), 0)), 0), 0) AS kme
  FROM emb JOIN mes USING (cell) JOIN gs USING (gene) JOIN ms USING (module) GROUP BY 1, 2)"""
HUB = "hub AS (SELECT * FROM (SELECT module, gene, kme, row_number() OVER (PARTITION BY module ORDER BY round(kme, 9) DESC, gene) AS rank FROM fix JOIN kme USING (gene, module) WHERE module <> 'grey') WHERE rank <= 5)"
GRP = "grp AS (SELECT vec_id AS cell, CAST(label AS VARCHAR) AS g FROM embeddings)"
PRD = "prd AS (SELECT x.g AS g1, y.g AS g2, module, cell, me, grp.g = x.g AS first FROM mes JOIN grp USING (cell) JOIN (SELECT DISTINCT g FROM grp) x ON true JOIN (SELECT DISTINCT g FROM grp) y ON x.g < y.g WHERE grp.g IN (x.g, y.g))"
MOT = "mot AS (SELECT a.gene AS tf, b.gene FROM (SELECT DISTINCT gene FROM emb WHERE gene < 'g10') a JOIN (SELECT DISTINCT gene FROM emb) b ON a.gene <> b.gene WHERE ('0x' || substr(md5('42#' || a.gene || '#' || b.gene), 1, 8))::BIGINT / 4294967296.0 < 0.2)"
EDG = "edg AS (SELECT tf, gene, ('0x' || substr(md5('gain#' || tf || '#' || gene), 1, 8))::BIGINT / 4294967296.0 AS gain, cor FROM mot JOIN pairs ON g1 = least(tf, gene) AND g2 = greatest(tf, gene))"
REG = "reg AS (SELECT tf, gene, gain, cor, gain * sign(cor) AS reg_score FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY gain DESC, tf) AS r FROM edg WHERE gain >= 0.01) WHERE r <= 10)"


def sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def query(name: str, text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# --- shared inputs --------------------------------------------------------------


def sup(spark, d):
    return views.supplier_brands(spark, d)


def sup_pairs(spark, d):
    x = sup(spark, d)
    return correlation.pearson(x, features.count_cells(x))


def sup_tom(spark, d, pick="min", plan="relational"):
    return network.topological_overlap(network.adjacency(sup_pairs(spark, d), 6), pick, plan)


def emb(spark, d):
    return views.embedding_dims(spark, d)


def emb_cells(spark, d):
    return views.read(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label"))


def emb_modules(spark, d):
    return views.fixed_modules(emb(spark, d).select("gene").distinct())


def emb_mes(spark, d):
    return modules.mean_expression(emb(spark, d), emb_modules(spark, d).where("module <> 'grey'"))


def emb_kme(spark, d):
    return modules.kme(emb(spark, d), emb_mes(spark, d), features.count_cells(emb(spark, d)))


def emb_hubs(spark, d, n=5):
    return modules.hub_genes(emb_modules(spark, d), emb_kme(spark, d), n)


def emb_pairs(spark, d):
    x = emb(spark, d)
    return correlation.pearson(x, features.count_cells(x))


def emb_tom(spark, d):
    return network.topological_overlap(network.adjacency(emb_pairs(spark, d), 6))


def emb_coords(spark, d):
    e = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").cast("string").alias("group"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("coords"))
    return e


def motif_table(spark, d):
    g = emb(spark, d).select("gene").distinct()
    x = g.where("gene < 'g10'").select(F.col("gene").alias("tf")).join(g, F.col("tf") != F.col("gene"))
    return x.where(regulation.hash_share(F.lit("42"), F.col("tf"), F.col("gene")) < 0.2)


def edges(spark, d):
    x = regulation.tf_gene_cor(motif_table(spark, d), emb_pairs(spark, d))
    return x.withColumn("gain", regulation.hash_share(F.lit("gain"), F.col("tf"), F.col("gene")))


def regs(spark, d):
    return regulation.regulons(edges(spark, d), "A")


# --- features -------------------------------------------------------------------


@query("gene_fraction", sql(CNT, "SELECT gene, round(count(*) FILTER (value > 0) / CAST((SELECT count(DISTINCT cell) FROM cnt) AS DOUBLE), 6) AS frac FROM cnt GROUP BY 1 HAVING count(*) FILTER (value > 0) / CAST((SELECT count(DISTINCT cell) FROM cnt) AS DOUBLE) >= 0.05"))
def gene_fraction(spark, d):
    x = keep(views.customer_items(spark, d))
    return r6(features.gene_fraction(x, features.count_cells(x)), "frac")


@query("gene_cv2", sql(CNT, "n AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM cnt)", "v AS (SELECT gene, sum(value) / max(n) AS mean, sum(value * value) / max(n) AS sq FROM cnt, n GROUP BY 1)", "c AS (SELECT gene, (sq - mean * mean) / (mean * mean + 1e-8) AS cv2 FROM v)", "SELECT gene, round(cv2, 6) AS cv2 FROM c ORDER BY round(cv2, 9) DESC, gene DESC LIMIT 40"))
def gene_cv2(spark, d):
    x = keep(views.customer_items(spark, d))
    return r6(features.gene_cv2(x, features.count_cells(x), 40), "cv2")


WANTED = ["Brand#33", "Brand#11", "Brand#99", "Brand#25"]


@query("gene_custom", sql(SUP, "w(gene, ord) AS (VALUES ('Brand#33', 0), ('Brand#11', 1), ('Brand#99', 2), ('Brand#25', 3))", "SELECT gene, CAST(ord AS INT) AS ord FROM w WHERE gene IN (SELECT gene FROM sup)"))
def gene_custom(spark, d):
    return features.gene_custom(sup(spark, d), WANTED)


@query("good_genes", sql(CNT, "n AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM cnt)", "SELECT gene, round((sum(value * value) - sum(value) * sum(value) / max(n)) / (max(n) - 1), 6) AS variance FROM cnt, n GROUP BY 1"))
def good_genes(spark, d):
    x = keep(views.customer_items(spark, d))
    return r6(features.good_genes(x, features.count_cells(x)), "variance")


@query("log_normalize", sql(CNT, "SELECT cell, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell) * 10000), 6) AS value FROM cnt"))
def log_normalize(spark, d):
    return r6(features.log_normalize(views.customer_items(spark, d)), "value")


def _bulk(method, value):
    text = sql(CNT, "sz AS (SELECT c_mktsegment, count(*) AS n_cells FROM customer GROUP BY 1)", f"SELECT c_mktsegment, gene, round({value}, 6) AS value, max(n_cells) AS n_cells FROM cnt JOIN customer ON cell = c_custkey JOIN sz USING (c_mktsegment) GROUP BY 1, 2")
    return query(f"pseudobulk_{method}", text)(lambda spark, d: r6(features.pseudobulk(views.customer_items(spark, d), views.customers(spark, d), ["c_mktsegment"], method), "value"))


_bulk("mean", "sum(value) / max(n_cells)")
_bulk("sum", "sum(value)")


@query("min_cells_groups", """SELECT c_mktsegment || '#' || CAST(n_regionkey AS VARCHAR) AS "group", count(*) AS n_cells FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 50""")
def min_cells_groups(spark, d):
    return features.min_cells_groups(views.customers(spark, d), ["c_mktsegment", "n_regionkey"], 50)


# --- correlation and network ------------------------------------------------------


@query("corr_pearson", sql(CNT, pairs_sql("cnt"), "SELECT g1, g2, round(cor, 6) AS cor FROM pairs"))
def corr_pearson(spark, d):
    x = keep(views.customer_items(spark, d))
    return r6(correlation.pearson(x, features.count_cells(x), "blocked"), "cor")


@query("corr_pearson_relational", sql(SUP, pairs_sql("sup"), "SELECT g1, g2, round(cor, 6) AS cor FROM pairs"))
def corr_pearson_relational(spark, d):
    return r6(sup_pairs(spark, d), "cor")


@query("corr_spearman", sql(CNT, "cells AS (SELECT DISTINCT cell FROM cnt)", "genes AS (SELECT DISTINCT gene FROM cnt)", "full_ AS (SELECT c.cell, g.gene, coalesce(value, 0) AS value FROM cells c CROSS JOIN genes g LEFT JOIN cnt USING (cell, gene))", "rk AS (SELECT cell, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS value FROM full_)", pairs_sql("rk"), "SELECT g1, g2, round(cor, 6) AS cor FROM pairs"))
def corr_spearman(spark, d):
    x = keep(views.customer_items(spark, d))
    return r6(correlation.spearman(x, features.count_cells(x), "blocked"), "cor")


@query("corr_bicor", sql(SUP, "cells AS (SELECT DISTINCT cell FROM sup)", "genes AS (SELECT DISTINCT gene FROM sup)", "f AS (SELECT c.cell, g.gene, coalesce(value, 0) AS value FROM cells c CROSS JOIN genes g LEFT JOIN sup USING (cell, gene))", "md AS (SELECT gene, median(value) AS med FROM f GROUP BY 1)", "ad AS (SELECT gene, median(abs(value - med)) AS mad FROM f JOIN md USING (gene) GROUP BY 1)", "u AS (SELECT cell, gene, value - med AS c, (value - med) / (9 * CASE WHEN mad < 1e-15 THEN 1 ELSE mad END) AS u FROM f JOIN md USING (gene) JOIN ad USING (gene))", "z AS (SELECT cell, gene, CASE WHEN abs(u) < 1 THEN c * (1 - u * u) * (1 - u * u) ELSE 0 END AS z FROM u)", "nz AS (SELECT cell, gene, z / nullif(sqrt(sum(z * z) OVER (PARTITION BY gene)), 0) AS z FROM z)", "SELECT a.gene AS g1, b.gene AS g2, round(coalesce(sum(a.z * b.z), 0), 6) AS cor FROM nz a JOIN nz b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2"))
def corr_bicor(spark, d):
    x = sup(spark, d)
    return r6(correlation.correlate(x, features.count_cells(x), "bicor"), "cor")


@query("corr_bicor_sparse", sql(CNT, "cells AS (SELECT DISTINCT cell FROM cnt)", "genes AS (SELECT DISTINCT gene FROM cnt)", "f AS (SELECT c.cell, g.gene, coalesce(value, 0) AS value FROM cells c CROSS JOIN genes g LEFT JOIN cnt USING (cell, gene))", "md AS (SELECT gene, median(value) AS med FROM f GROUP BY 1)", "ad AS (SELECT gene, median(abs(value - med)) AS mad FROM f JOIN md USING (gene) GROUP BY 1)", "u AS (SELECT cell, gene, value - med AS c, (value - med) / (9 * CASE WHEN mad < 1e-15 THEN 1 ELSE mad END) AS u FROM f JOIN md USING (gene) JOIN ad USING (gene))", "z AS (SELECT cell, gene, CASE WHEN abs(u) < 1 THEN c * (1 - u * u) * (1 - u * u) ELSE 0 END AS z FROM u)", "nz AS (SELECT cell, gene, z / nullif(sqrt(sum(z * z) OVER (PARTITION BY gene)), 0) AS z FROM z)", "SELECT a.gene AS g1, b.gene AS g2, round(coalesce(sum(a.z * b.z), 0), 6) AS cor FROM nz a JOIN nz b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2"))
def corr_bicor_sparse(spark, d):
    """On the sparse view, where most values are absent zeros."""
    x = keep(views.customer_items(spark, d))
    return r6(correlation.correlate(x, features.count_cells(x), "bicor", "blocked"), "cor")


def _adj(name, kind, expr):
    query(name, sql(SUP, pairs_sql("sup"), adj_sql(6, expr), "SELECT g1, g2, round(adj, 6) AS adj FROM adj"))(lambda spark, d: r6(network.adjacency(sup_pairs(spark, d), 6, kind), "adj"))


_adj("adj_signed", "signed", "(1 + cor) / 2")
_adj("adj_unsigned", "unsigned", "abs(cor)")
_adj("adj_hybrid", "signed hybrid", "greatest(cor, 0)")


@query("degrees", sql(SUP, pairs_sql("sup"), adj_sql(), DEG, "SELECT gene, round(k, 6) AS k FROM deg"))
def degrees(spark, d):
    return r6(network.degrees(network.adjacency(sup_pairs(spark, d), 6)), "k")


PWR = "pw AS (SELECT CAST(unnest([1,2,3,4,5,6,7,8,9,10,12,14,16,18,20,22,24,26,28,30]) AS INT) AS power), kk AS (SELECT power, gene, sum(power(greatest((1 + cor) / 2, 1e-300), power)) AS k FROM (SELECT g1 AS gene, cor FROM pairs UNION ALL SELECT g2, cor FROM pairs), pw GROUP BY 1, 2)"
BIN = """sp AS (SELECT power, min(k) AS lo, max(k) AS hi, count(*) AS n FROM kk GROUP BY 1),
hb AS (SELECT power, coalesce(least(9, greatest(0, CAST(ceil(round((k - lo) / nullif((hi - lo) / 10, 0), 9)) AS INT) - 1)), 0) AS bin, avg(k) AS mean, count(*) AS c FROM kk JOIN sp USING (power) GROUP BY 1, 2),
bins AS (SELECT power, CAST(b.bin AS INT) AS bin, CASE WHEN coalesce(mean, 0) = 0 THEN lo + (hi - lo) * (b.bin + 0.5) / 10 ELSE mean END AS dk, coalesce(c, 0) / CAST(n AS DOUBLE) AS p_dk, n
  FROM sp CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN hb USING (power, bin))"""
FIT = """lx AS (SELECT power, n, log10(greatest(dk, 1e-9)) AS x, log10(p_dk + 1e-9) AS y, greatest(dk, 1e-9) AS z FROM bins),
cx AS (SELECT power, n, x - avg(x) OVER (PARTITION BY power) AS x, y - avg(y) OVER (PARTITION BY power) AS y, z - avg(z) OVER (PARTITION BY power) AS z FROM lx),
ss AS (SELECT power, max(n) AS n, count(*) AS m, sum(x*x) AS xx, sum(y*y) AS yy, sum(z*z) AS zz, sum(x*y) AS xy, sum(x*z) AS xz, sum(z*y) AS zy FROM cx GROUP BY 1),
ft AS (SELECT power, coalesce(greatest(0.0, xy / nullif(xx, 0) * xy / nullif(yy, 0)), 0) AS r2, coalesce(xy / nullif(xx, 0), 0) AS slope,
  greatest(0.0, coalesce(1 - (1 - ((xy * zz - zy * xz) * xy + (zy * xx - xy * xz) * zy) / nullif(xx * zz - xz * xz, 0) / nullif(yy, 0)) * (m - 1) / (m - 3), 0)) AS tr2 FROM ss)"""


@query("power_scan", sql(SUP, pairs_sql("sup"), PWR, BIN, FIT, "SELECT power, round(r2, 6) AS sft_r_sq, round(slope, 6) AS slope, round(tr2, 5) AS truncated_r_sq, round(avg(k), 6) AS mean_k, round(median(k), 6) AS median_k, round(max(k), 6) AS max_k FROM ft JOIN kk USING (power) GROUP BY 1, r2, slope, tr2"))
def power_scan(spark, d):
    t = network.power_table(sup_pairs(spark, d))
    return r6(t, "sft_r_sq", "slope", "mean_k", "median_k", "max_k").withColumn("truncated_r_sq", F.round("truncated_r_sq", 5))


@query("scale_free_bins", sql(SUP, pairs_sql("sup"), PWR, BIN, "SELECT power, bin, round(dk, 6) AS dk, round(p_dk, 6) AS p_dk FROM bins"))
def scale_free_bins(spark, d):
    return r6(network.scale_free_bins(network.powered_degrees(sup_pairs(spark, d))).select("power", "bin", "dk", "p_dk"), "dk", "p_dk")


@query("scale_free_fit", sql(SUP, pairs_sql("sup"), PWR, BIN, FIT, "SELECT power, round(r2, 6) AS sft_r_sq, round(slope, 6) AS slope FROM ft"))
def scale_free_fit(spark, d):
    return r6(network.scale_free_fit(network.powered_degrees(sup_pairs(spark, d))).select("power", "sft_r_sq", "slope"), "sft_r_sq", "slope")


@query("tom_min", sql(SUP, pairs_sql("sup"), adj_sql(), tom_sql(), "SELECT g1, g2, round(tom, 6) AS tom FROM tom"))
def tom_min(spark, d):
    return r6(sup_tom(spark, d), "tom")


@query("tom_max", sql(SUP, pairs_sql("sup"), adj_sql(), tom_sql("greatest"), "SELECT g1, g2, round(tom, 6) AS tom FROM tom"))
def tom_max(spark, d):
    return r6(sup_tom(spark, d, "max"), "tom")


@query("topological_overlap", sql(CNT, pairs_sql("cnt"), adj_sql(), tom_sql(), "SELECT g1, g2, round(tom, 6) AS tom FROM tom"))
def topological_overlap(spark, d):
    """Flagship: correlation, adjacency and overlap of the sparse view, all by the blocked plan."""
    x = keep(views.customer_items(spark, d))
    adj = network.adjacency(correlation.pearson(x, features.count_cells(x), "blocked"), 6)
    return r6(network.topological_overlap(adj, "min", "blocked"), "tom")


@query("linkage")
def linkage(spark, d):
    return r6(clustering.linkage(sup_tom(spark, d)), "height")


@query("dendrogram")
def dendrogram(spark, d):
    return r6(clustering.dendrogram(sup_tom(spark, d))[1], "x0", "y0", "x1", "y1")


@query("module_first_appearance", sql(EMB, FIX, 'SELECT module, "first", CAST(row_number() OVER (ORDER BY "first") AS INT) AS ord FROM (SELECT module, min(CAST(substr(gene, 2) AS INT) * 37 % 64) AS "first" FROM fix GROUP BY 1)'))
def module_first_appearance(spark, d):
    m = emb_modules(spark, d)
    return modules.first_appearance(m, m.select("gene", (F.substring("gene", 2, 9).cast("int") * 37 % 64).alias("place")))


@query("module_detect")
def module_detect(spark, d):
    return clustering.detect_modules(emb_tom(spark, d), "gap", min_size=5)


@query("module_hybrid")
def module_hybrid(spark, d):
    return clustering.detect_modules(emb_tom(spark, d), "hybrid", min_size=5)


@query("module_assign", sql(EMB, FIX, pairs_sql("emb"), adj_sql(), tom_sql(), """
lb AS (SELECT gene, CASE WHEN module = 'grey' THEN 0 ELSE CAST(substr(module, 2) AS INT) END AS cluster FROM fix),
ln AS (SELECT g1 AS gene, g2 AS other, tom FROM tom UNION ALL SELECT g2, g1, tom FROM tom),
fa AS (SELECT ln.gene, o.cluster AS goal, avg(1 - tom) AS far FROM ln JOIN lb o ON o.gene = ln.other WHERE o.cluster > 0 GROUP BY 1, 2),
di AS (SELECT goal, max(far) AS diameter FROM fa JOIN lb USING (gene) WHERE cluster = goal GROUP BY 1),
ne AS (SELECT gene, arg_min(goal, (far, goal)) AS goal, min(far) AS far FROM fa JOIN lb USING (gene) WHERE cluster = 0 GROUP BY 1)""", """
SELECT gene, CASE WHEN cluster > 0 THEN cluster WHEN far < greatest(diameter, 0.98) THEN goal ELSE 0 END AS cluster FROM lb LEFT JOIN ne USING (gene) LEFT JOIN di USING (goal)"""))
def module_assign(spark, d):
    """The step by distance of the hybrid cut: grey genes meet the mean distance to the seven given modules."""
    given = emb_modules(spark, d).select("gene", F.coalesce(F.regexp_extract("module", r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("cluster"), F.lit(0).alias("small"), F.lit(0).alias("root"))
    return tree_cut.assign_by_distance(emb_tom(spark, d), given, 0.98)


@query("module_merge")
def module_merge(spark, d):
    return clustering.merge_close(emb_modules(spark, d), modules.module_correlation(emb_mes(spark, d)), 0.9)


@query("module_palette", sql(EMB, FIX, "SELECT module, CASE WHEN module = 'grey' THEN 'grey' ELSE ['turquoise', 'blue', 'brown', 'yellow', 'green', 'red', 'black'][CAST(substr(module, 2) AS INT)] END AS color FROM (SELECT DISTINCT module FROM fix)"))
def module_palette(spark, d):
    return network.palette(emb_modules(spark, d))


# --- metacells --------------------------------------------------------------------

KNN = """co AS (SELECT vec_id, CAST(label AS VARCHAR) AS g, embedding[1:8] AS c FROM embeddings),
pr AS (SELECT a.g, a.vec_id AS cell, b.vec_id AS neighbour, round(list_sum([(CAST(a.c[i] AS DOUBLE) - b.c[i]) * (CAST(a.c[i] AS DOUBLE) - b.c[i]) FOR i IN range(1, 9)]), 9) AS d2 FROM co a JOIN co b ON a.g = b.g AND a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT g, cell, neighbour, d2, row_number() OVER (PARTITION BY g, cell ORDER BY d2, neighbour) AS rank FROM pr) WHERE rank <= 5)"""


@query("knn_within_group", sql(KNN, 'SELECT g AS "group", cell, neighbour, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM knn'))
def knn_within_group(spark, d):
    return r6(metacells.knn_within_group(emb_coords(spark, d), 5), "d2")


@query("metacells", sql(KNN.replace("rank <= 5", "rank <= 9"), """
hood AS (SELECT g, cell, list_append(list(neighbour), cell) AS hood FROM knn GROUP BY 1, 2),
ord AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(CAST(cell AS VARCHAR) || '#0'), cell) AS place FROM hood),
walk AS (SELECT g, 0 AS place, CAST([] AS BIGINT[][]) AS taken FROM (SELECT DISTINCT g FROM hood)
  UNION ALL SELECT w.g, o.place, CASE WHEN coalesce(list_max([len(list_intersect(t, o.hood)) FOR t IN w.taken]), 0) <= 5 THEN list_append(w.taken, o.hood) ELSE w.taken END
  FROM walk w JOIN ord o ON o.g = w.g AND o.place = w.place + 1),
fin AS (SELECT g, arg_max(taken, place) AS taken FROM walk GROUP BY 1),
num AS (SELECT g, taken, unnest(range(1, len(taken) + 1)) AS i FROM fin WHERE len(taken) > 1)""", """SELECT g AS "group", g || '_' || i AS metacell, unnest(taken[i]) AS cell FROM num""").replace("WITH ", "WITH RECURSIVE ", 1))
def metacell_query(spark, d):
    return metacells.metacell_members(emb_coords(spark, d), 10, 5)


@query("metacell_expr_from_members", sql(CNT, "mem AS (SELECT c_custkey AS cell, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS metacell FROM customer)", "SELECT metacell AS cell, gene, round(sum(value) / 25, 6) AS value FROM cnt JOIN mem USING (cell) GROUP BY 1, 2"))
def metacell_expr(spark, d):
    mem = views.read(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string")).alias("metacell"))
    return r6(metacells.aggregate_members(views.customer_items(spark, d), mem, 25), "value")


# --- modules ----------------------------------------------------------------------


@query("eigengenes")
def eigengenes(spark, d):
    x = emb(spark, d)
    return r6(modules.eigengenes(x, emb_modules(spark, d), features.count_cells(x)), "me")


SPE = """ld AS (SELECT gene, split_part(gene, '/', 1) AS module, (1 + length(gene) % 5) / 10.0 AS l FROM (SELECT DISTINCT gene FROM cnt)),
sm AS (SELECT gene, sum(value) / n AS mean, sqrt((sum(value * value) - sum(value) * sum(value) / n) / (n - 1)) AS sd FROM cnt, (SELECT count(*)::DOUBLE AS n FROM customer) GROUP BY gene, n),
zs AS (SELECT c_custkey AS cell, gene, greatest(-10.0, least(10.0, (coalesce(value, 0) - mean) / sd)) AS z FROM customer CROSS JOIN sm LEFT JOIN cnt ON cnt.cell = c_custkey AND cnt.gene = sm.gene)"""


@query("sparse_scores", sql(CNT, SPE.replace("sm.gene)", "sm.gene)").replace("SELECT c_custkey AS cell, gene,", "SELECT c_custkey AS cell, sm.gene,"), "SELECT cell, module, round(sum(z * l), 5) + 0.0 AS me FROM zs JOIN ld USING (gene) GROUP BY 1, 2"))
def sparse_scores(spark, d):
    """Scores of given loadings on the sparse view, for all customers, also those without an order."""
    x, c = keep(views.customer_items(spark, d)), views.customers(spark, d)
    loads = x.select("gene").distinct().select("gene", F.split("gene", "/")[0].alias("module"), ((1 + F.length("gene") % 5) / 10.0).alias("loading"))
    out = modules.weighted_scores(*modules.standardise(x, c.count()), loads, c)
    return out.withColumn("me", F.round("me", 5) + F.lit(0.0))


@query("sparse_eigengenes")
def sparse_eigengenes(spark, d):
    x, c = keep(views.customer_items(spark, d)), views.customers(spark, d)
    m = x.select("gene").distinct().select("gene", F.split("gene", "/")[0].alias("module"))
    return r6(modules.eigengenes(x, m, c.count(), cells=c), "me")


@query("harmonized_eigengenes", sql(EMB, FIX, MES, GRP, "SELECT cell, module, round(me - avg(me) OVER (PARTITION BY module, g) + avg(me) OVER (PARTITION BY module), 6) + 0.0 AS me FROM mes JOIN grp USING (cell)"))
def harmonized(spark, d):
    return r6(modules.harmonize(emb_mes(spark, d), emb_cells(spark, d), ["label"]), "me")


@query("kme", sql(EMB, FIX, MES, KME, "SELECT gene, module, round(kme, 6) AS kme FROM kme"))
def kme(spark, d):
    return r6(emb_kme(spark, d), "kme")


@query("kme_bicor", sql(EMB, FIX, MES, """al AS (SELECT cell, 'x' AS side, gene AS k, value AS v FROM emb UNION ALL SELECT cell, 'y', module, me FROM mes),
md AS (SELECT side, k, median(v) AS med FROM al GROUP BY 1, 2), ad AS (SELECT side, k, med, median(abs(v - med)) AS mad FROM al JOIN md USING (side, k) GROUP BY 1, 2, 3),
uu AS (SELECT cell, side, k, v - med AS c, (v - med) / (9 * CASE WHEN mad < 1e-15 THEN 1 ELSE mad END) AS u FROM al JOIN ad USING (side, k)),
zz AS (SELECT cell, side, k, CASE WHEN abs(u) < 1 THEN c * (1 - u * u) * (1 - u * u) ELSE 0 END AS z FROM uu),
nz AS (SELECT cell, side, k, z / sqrt(sum(z * z) OVER (PARTITION BY side, k)) AS z FROM zz)""", "SELECT a.k AS gene, b.k AS module, round(sum(a.z * b.z), 6) + 0.0 AS kme FROM nz a JOIN nz b ON a.cell = b.cell AND a.side = 'x' AND b.side = 'y' GROUP BY 1, 2"))
def kme_bicor(spark, d):
    return r6(modules.kme_bicor(emb(spark, d), emb_mes(spark, d), features.count_cells(emb(spark, d))), "kme")


@query("hub_genes", sql(EMB, FIX, MES, KME, HUB, "SELECT module, gene, round(kme, 6) AS kme, CAST(rank AS INT) AS rank FROM hub"))
def hubs(spark, d):
    return r6(emb_hubs(spark, d), "kme")


@query("reassign_negative_kme", sql(EMB, FIX, "shift AS (SELECT gene, CASE WHEN module = 'grey' THEN 'grey' ELSE 'M' || (1 + (CAST(substr(module, 2) AS INT) + 2) % 7) END AS module FROM fix)", MES, KME, "b AS (SELECT gene, arg_max(module, (round(kme, 9), module)) AS best, max(round(kme, 9)) AS k FROM kme GROUP BY 1)", "SELECT s.gene, s.module, CASE WHEN round(o.kme, 9) < 0 THEN CASE WHEN k < 0 THEN 'grey' ELSE best END ELSE s.module END AS new_module FROM shift s LEFT JOIN kme o ON o.gene = s.gene AND o.module = s.module LEFT JOIN b ON b.gene = s.gene"))
def reassign(spark, d):
    n = (F.regexp_extract("module", r"(\d+)", 1).try_cast("int") + 2) % 7 + 1
    moved = emb_modules(spark, d).select("gene", F.when(F.col("module") == "grey", "grey").otherwise(F.concat(F.lit("M"), n.cast("string"))).alias("module"))
    return modules.reassign_negative(moved, emb_kme(spark, d))


@query("rename_modules", sql(EMB, FIX, "SELECT gene, module, CASE WHEN module = 'grey' THEN 'grey' ELSE 'OPC' || substr(module, 2) END AS new_module FROM fix"))
def rename(spark, d):
    return modules.rename_modules(emb_modules(spark, d), "OPC")


@query("avg_module_expr", sql(EMB, FIX, MES, KME, HUB, "SELECT cell, module, round(sum(value) / 5, 6) + 0.0 AS score FROM emb JOIN hub USING (gene) GROUP BY 1, 2"))
def avg_expr(spark, d):
    return r6(analysis.average_expression(emb(spark, d), emb_hubs(spark, d)), "score")


MSC = """mn AS (SELECT gene, round(sum(value) / (SELECT count(DISTINCT cell) FROM cnt), 9) AS mean FROM cnt GROUP BY 1),
ed AS (SELECT quantile_cont(mean, [i / 25.0 FOR i IN range(1, 25)]) AS e FROM mn WHERE mean > 0),
bi AS (SELECT gene, len([x FOR x IN e IF x <= mean]) AS bin, len([x FOR x IN e IF x < mean]) AS place FROM mn, ed),
tp AS (SELECT DISTINCT gene, split_part(gene, '/', 1) AS module FROM cnt),
wt AS (SELECT DISTINCT module, place AS bin, size FROM tp JOIN bi USING (gene) JOIN (SELECT module, count(*) AS size FROM tp GROUP BY 1) USING (module)),
ct AS (SELECT DISTINCT module, gene FROM (SELECT module, b.gene, size, row_number() OVER (PARTITION BY module, bin ORDER BY md5('42#' || module || '#' || b.gene), b.gene) AS r
  FROM wt JOIN bi b USING (bin) WHERE (module, b.gene) NOT IN (SELECT (module, gene) FROM tp)) WHERE r <= size),
sa AS (SELECT cell, module, sum(value) / max(size) AS s FROM cnt JOIN (SELECT *, count(*) OVER (PARTITION BY module) AS size FROM tp) USING (gene) WHERE module IN (SELECT module FROM ct) GROUP BY 1, 2),
sb AS (SELECT cell, module, sum(value) / max(size) AS s FROM cnt JOIN (SELECT *, count(*) OVER (PARTITION BY module) AS size FROM ct) USING (gene) GROUP BY 1, 2)"""


@query("module_expr_score", sql(CNT, MSC, "SELECT cell, module, round(coalesce(sa.s, 0) - coalesce(sb.s, 0), 6) + 0.0 AS score FROM sa FULL JOIN sb USING (cell, module)"))
def module_expr_score(spark, d):
    x = keep(views.customer_items(spark, d))
    tops = x.select("gene").distinct().select(F.split("gene", "/")[0].alias("module"), "gene")
    return r6(analysis.module_score(x, tops, features.count_cells(x)), "score")


# --- differential scores, traits, overlap -------------------------------------------


def paired(spark, d):
    return analysis.group_pairs(emb_mes(spark, d), emb_cells(spark, d), "label")


@query("dme_effects", sql(EMB, FIX, MES, GRP, PRD, "SELECT g1, g2, module, round(avg(CASE WHEN first THEN CAST(me <> 0 AS INT) END), 4) AS pct_1, round(avg(CASE WHEN NOT first THEN CAST(me <> 0 AS INT) END), 4) AS pct_2, round(avg(CASE WHEN NOT first THEN me END) - avg(CASE WHEN first THEN me END), 6) + 0.0 AS avg_log2fc, count(*) FILTER (first) AS n_1, count(*) FILTER (NOT first) AS n_2 FROM prd GROUP BY 1, 2, 3"))
def dme_effects(spark, d):
    return r6(analysis.dme_effects(paired(spark, d)), "avg_log2fc")


RSU = """rr AS (SELECT g1, g2, module, first, rank() OVER (PARTITION BY g1, g2, module ORDER BY me) + (count(*) OVER (PARTITION BY g1, g2, module, me) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY g1, g2, module, me) AS t FROM prd),
ru AS (SELECT g1, g2, module, CAST(count(*) FILTER (first) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT first) AS DOUBLE) AS n2, sum(CASE WHEN first THEN rk ELSE 0 END) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS tt FROM rr GROUP BY 1, 2, 3),
uu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 / 12 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1))) AS sd2 FROM ru)"""


@query("ranksum_u_z", sql(EMB, FIX, MES, GRP, PRD, RSU, "SELECT g1, g2, module, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u1, round(coalesce((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sqrt(sd2), 0), 0), 6) AS z FROM uu"))
def ranksum(spark, d):
    return r6(stats.rank_sum(paired(spark, d), ["g1", "g2", "module"], "me", F.col("first")), "z")


@query("dme_wilcox")
def dme_wilcox(spark, d):
    return r6(analysis.find_dmes(emb_mes(spark, d), emb_cells(spark, d), "label"), "avg_log2fc", "p_val", "p_val_adj")


@query("dme_ttest")
def dme_ttest(spark, d):
    return r6(analysis.find_dmes(emb_mes(spark, d), emb_cells(spark, d), "label", "t"), "avg_log2fc", "p_val", "p_val_adj")


@query("welch_t_stat", sql(EMB, FIX, MES, GRP, PRD, "w AS (SELECT g1, g2, module, avg(me) FILTER (first) AS m1, avg(me) FILTER (NOT first) AS m2, var_samp(me) FILTER (first) / count(*) FILTER (first) AS s1, var_samp(me) FILTER (NOT first) / count(*) FILTER (NOT first) AS s2, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2 FROM prd GROUP BY 1, 2, 3)", "SELECT g1, g2, module, round((m1 - m2) / nullif(sqrt(s1 + s2), 0), 6) + 0.0 AS t, round((s1 + s2) * (s1 + s2) / nullif(s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1), 0), 6) AS df FROM w"))
def welch_t(spark, d):
    return r6(stats.welch(paired(spark, d), ["g1", "g2", "module"], "me", F.col("first")), "t", "df")


@query("bh_fdr", sql("p AS (SELECT l_returnflag || l_linestatus AS family, l_suppkey AS key, (('0x' || substr(md5(CAST(l_suppkey AS VARCHAR) || l_returnflag || l_linestatus), 1, 8))::BIGINT) / 4294967296.0 AS p FROM lineitem GROUP BY 1, 2, l_returnflag, l_linestatus)", "r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)", "SELECT family, key, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM r"))
def bh_fdr(spark, d):
    x = views.read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()
    h = F.md5(F.concat(F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus"))
    x = x.select(F.concat("l_returnflag", "l_linestatus").alias("family"), F.col("l_suppkey").alias("key"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("p"))
    return r6(stats.bh(x, "p", ["family"]), "p", "fdr")


def trait_cells(spark, d):
    return emb(spark, d).where("gene in ('g07', 'g15', 'g23')").groupBy("cell").pivot("gene", ["g07", "g15", "g23"]).agg(F.first("value"))


TRT = "trt AS (SELECT cell, gene AS trait, value AS x FROM emb WHERE gene IN ('g07', 'g15', 'g23')), tm AS (SELECT trait, module, cell, x, me FROM trt JOIN mes USING (cell))"
TCO = "SELECT trait, module, count(*) AS n, round(coalesce((count(*) * sum(x * me) - sum(x) * sum(me)) / nullif(sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(me * me) - sum(me) * sum(me))), 0), 0), 6) AS cor FROM {} GROUP BY 1, 2"


@query("trait_cor_pearson", sql(EMB, FIX, MES, TRT, TCO.format("tm")))
def trait_pearson(spark, d):
    return r6(analysis.trait_correlation(emb_mes(spark, d), trait_cells(spark, d), ["g07", "g15", "g23"]), "cor")


@query("trait_cor_spearman", sql(EMB, FIX, MES, TRT, "tr AS (SELECT trait, module, rank() OVER (PARTITION BY trait, module ORDER BY x) + (count(*) OVER (PARTITION BY trait, module, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY trait, module ORDER BY me) + (count(*) OVER (PARTITION BY trait, module, me) - 1) / 2.0 AS me FROM tm)", TCO.format("tr")))
def trait_spearman(spark, d):
    return r6(analysis.trait_correlation(emb_mes(spark, d), trait_cells(spark, d), ["g07", "g15", "g23"], "spearman"), "cor")


@query("trait_cor_pvalue")
def trait_p(spark, d):
    return r6(analysis.trait_p_values(analysis.trait_correlation(emb_mes(spark, d), trait_cells(spark, d), ["g07", "g15", "g23"])), "cor", "pval", "fdr")


def gene_sets(spark, d):
    """(gene, group): four overlapping sets of components by hash."""
    g = emb(spark, d).select("gene").distinct()
    return g.select("gene", F.explode(F.array(*(F.lit(f"s{i}") for i in range(4)))).alias("group")).where(regulation.hash_share(F.lit("set"), F.col("group"), F.col("gene")) < 0.4)


OVL = """st AS (SELECT gene, 's' || i AS g FROM (SELECT DISTINCT gene FROM emb), range(4) t(i) WHERE ('0x' || substr(md5('set#s' || i || '#' || gene), 1, 8))::BIGINT / 4294967296.0 < 0.4),
ov AS (SELECT m.module, s.g, size_module, size_set, coalesce(c, 0) AS a FROM (SELECT module, count(*) AS size_module FROM fix WHERE module <> 'grey' GROUP BY 1) m CROSS JOIN (SELECT g, count(*) AS size_set FROM st GROUP BY 1) s LEFT JOIN (SELECT module, g, count(*) AS c FROM st JOIN fix USING (gene) GROUP BY 1, 2) x ON x.module = m.module AND x.g = s.g)"""


@query("overlap_counts", sql(EMB, FIX, OVL, 'SELECT module, g AS "group", size_module, size_set, a AS size_intersection FROM ov'))
def overlap_counts(spark, d):
    return analysis.overlap_counts(emb_modules(spark, d), gene_sets(spark, d))


@query("overlap_jaccard", sql(EMB, FIX, OVL, 'SELECT module, g AS "group", round(a / CAST(size_module + size_set - a AS DOUBLE), 6) AS jaccard, round(a * (64.0 - size_module - size_set + a) / nullif((size_module - a) * (size_set - a), 0), 6) AS odds_ratio FROM ov'))
def overlap_jaccard(spark, d):
    x = analysis.overlap_test(analysis.overlap_counts(emb_modules(spark, d), gene_sets(spark, d)), emb_modules(spark, d).count())
    return r6(x.select("module", "group", "jaccard", "odds_ratio"), "jaccard", "odds_ratio")


FSH = "lf AS (SELECT 0 AS i, 0.0 AS v UNION ALL SELECT CAST(i AS INT), sum(ln(i)) OVER (ORDER BY i) FROM range(1, 65) t(i)), hy AS (SELECT module, g, size_module AS m, size_set AS k, a, unnest(range(a, least(size_module, size_set) + 1)) AS i FROM ov)"


@query("fisher_exact", sql(EMB, FIX, OVL, FSH, """SELECT module, g AS "group", round(least(1.0, sum(exp(lm.v - li.v - lmi.v + lo.v - lki.v - lr.v - (ln_.v - lk.v - lnk.v)))), 6) AS pval FROM hy
JOIN lf lm ON lm.i = hy.m JOIN lf li ON li.i = hy.i JOIN lf lmi ON lmi.i = hy.m - hy.i JOIN lf lo ON lo.i = 64 - hy.m JOIN lf lki ON lki.i = hy.k - hy.i JOIN lf lr ON lr.i = 64 - hy.m - hy.k + hy.i JOIN lf ln_ ON ln_.i = 64 JOIN lf lk ON lk.i = hy.k JOIN lf lnk ON lnk.i = 64 - hy.k GROUP BY 1, 2"""))
def fisher_exact(spark, d):
    x = analysis.overlap_test(analysis.overlap_counts(emb_modules(spark, d), gene_sets(spark, d)), emb_modules(spark, d).count())
    return r6(x.select("module", "group", "pval"), "pval")


@query("ora_enrichment")
def ora(spark, d):
    sets = gene_sets(spark, d).select(F.lit("hash").alias("library"), F.col("group").alias("term"), "gene")
    return r6(analysis.enrichment(emb_modules(spark, d), sets), "odds_ratio", "odds_ratio_marginal", "jaccard", "pval", "fdr", "combined_score")


# --- projection and preservation ------------------------------------------------------


@query("project_modules")
def project_modules(spark, d):
    x, e = emb(spark, d), emb_cells(spark, d)
    half = lambda r: x.join(e.where(F.col("label") % 2 == r), "cell", "left_semi")
    a, b = half(0), half(1)
    return r6(projection.project_modules(a, b, emb_modules(spark, d).where("module <> 'grey'"), features.count_cells(a), features.count_cells(b)), "score")


@query("project_given_loadings", sql(EMB, FIX, "SELECT cell, module, round(sum(value * (1 + CAST(substr(gene, 2) AS INT) % 5) / 10.0), 6) + 0.0 AS score FROM emb JOIN fix USING (gene) WHERE module <> 'grey' GROUP BY 1, 2"))
def project_given(spark, d):
    loads = emb_modules(spark, d).where("module <> 'grey'").withColumn("loading", (1 + F.substring("gene", 2, 9).cast("int") % 5) / 10.0)
    return r6(projection.project(emb(spark, d), loads), "score")


@query("preservation_observed", sql(EMB, FIX, pairs_sql("emb"), adj_sql(), tom_sql(), "SELECT a.module, max(sz.n) AS n_genes, round(2 * sum(tom), 6) AS observed FROM tom JOIN fix a ON a.gene = g1 JOIN fix b ON b.gene = g2 AND a.module = b.module JOIN (SELECT module, count(*) AS n FROM fix GROUP BY 1) sz ON sz.module = a.module WHERE a.module <> 'grey' GROUP BY 1"))
def preservation_observed(spark, d):
    return r6(projection.module_density(emb_tom(spark, d), emb_modules(spark, d)), "observed")


@query("module_preservation")
def preservation(spark, d):
    return r6(projection.preservation(emb_tom(spark, d), emb_modules(spark, d)), "observed", "mean", "sd", "z_summary", "median_rank")


# --- regulation -------------------------------------------------------------------------


@query("motif_links", sql(EMB, MOT, "SELECT tf, gene FROM mot"))
def motif_links(spark, d):
    return motif_table(spark, d)


@query("tf_gene_cor", sql(EMB, MOT, pairs_sql("emb"), "SELECT tf, gene, round(cor, 6) AS cor FROM mot JOIN pairs ON g1 = least(tf, gene) AND g2 = greatest(tf, gene)"))
def tf_gene_cor(spark, d):
    return r6(regulation.tf_gene_cor(motif_table(spark, d), emb_pairs(spark, d)), "cor")


@query("tf_network")
def tf_network(spark, d):
    """Links of the cross-validated trees with their correlations, and the score of those that make the regulons (strategy A)."""
    motifs = motif_table(spark, d)
    links = boosting.boost(emb(spark, d), motifs)[0].join(regulation.tf_gene_cor(motifs, emb_pairs(spark, d)), ["tf", "gene"])
    links = keep(links)
    chosen = regulation.regulons(links, "A").select("tf", "gene", "reg_score")
    return r6(links.join(chosen, ["tf", "gene"], "left"), "gain", "cover", "frequency", "cor", "reg_score")


def _reg(letter, key, other, n):
    where = "" if n is None else f" WHERE r <= {n}"
    text = sql(EMB, MOT, pairs_sql("emb"), EDG, f"SELECT tf, gene, round(gain, 6) AS gain, round(cor, 6) AS cor, round(gain * sign(cor), 6) AS reg_score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, {other}) AS r FROM edg WHERE gain >= 0.01){where}")
    query(f"regulons_{letter.lower()}", text)(lambda spark, d: r6(regulation.regulons(edges(spark, d), letter, n_tfs=n or 0, n_genes=n or 0), "gain", "cor", "reg_score"))


_reg("A", "gene", "tf", 2)
_reg("B", "tf", "gene", 5)
_reg("C", "tf", "gene", None)


@query("tf_targets_depth", sql(EMB, MOT, pairs_sql("emb"), EDG, REG, "f1 AS (SELECT 'g03' AS tf)", "s1 AS (SELECT * FROM reg WHERE tf IN (SELECT tf FROM f1))", "f2 AS (SELECT tf FROM f1 UNION SELECT gene FROM s1)", "SELECT 1 AS depth, tf, gene, round(reg_score, 6) AS reg_score FROM s1 UNION ALL SELECT 2, tf, gene, round(reg_score, 6) FROM reg WHERE tf IN (SELECT tf FROM f2)"))
def tf_targets(spark, d):
    return r6(regulation.targets_by_depth(regs(spark, d), ["g03"], 2), "reg_score")


@query("module_regulatory_network", sql(EMB, FIX, MOT, pairs_sql("emb"), EDG, REG, "e AS (SELECT a.module AS source, b.module AS target, reg_score FROM reg JOIN fix a ON a.gene = tf JOIN fix b ON b.gene = reg.gene WHERE reg.gene IN (SELECT tf FROM reg))", "mm AS (SELECT DISTINCT module FROM fix)", "nt AS (SELECT module, count(*) AS n FROM fix WHERE gene IN (SELECT tf FROM reg) GROUP BY 1)", "SELECT s.module AS source, t.module AS target, count(reg_score) FILTER (reg_score >= 0) AS n_pos, round(coalesce(sum(reg_score) FILTER (reg_score >= 0), 0), 6) AS sum_pos, count(reg_score) FILTER (reg_score < 0) AS n_neg, round(coalesce(sum(reg_score) FILTER (reg_score < 0), 0), 6) AS sum_neg, round(count(reg_score) FILTER (reg_score >= 0) / CAST(coalesce(max(n), 1) AS DOUBLE), 6) AS score_pos, round(count(reg_score) FILTER (reg_score < 0) / CAST(coalesce(max(n), 1) AS DOUBLE), 6) AS score_neg FROM mm s CROSS JOIN mm t LEFT JOIN e ON e.source = s.module AND e.target = t.module LEFT JOIN nt ON nt.module = s.module GROUP BY 1, 2"))
def module_regulation(spark, d):
    return r6(regulation.module_regulation(regs(spark, d), emb_modules(spark, d)), "sum_pos", "sum_neg", "score_pos", "score_neg")


@query("regulon_scores", sql(EMB, MOT, pairs_sql("emb"), EDG, REG, "rk AS (SELECT cell, gene, (row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) - 1) / 63.0 AS r FROM emb)", "SELECT cell, tf, round(1 - avg(r), 6) AS score FROM rk JOIN reg USING (gene) WHERE cor > 0.05 GROUP BY 1, 2"))
def regulon_scores(spark, d):
    return r6(regulation.regulon_scores(emb(spark, d), regs(spark, d)), "score")


@query("regulon_scores_without_grey", sql(EMB, FIX, MOT, pairs_sql("emb"), EDG, REG, "rk AS (SELECT cell, gene, (row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) - 1) / 63.0 AS r FROM emb)", "gr AS (SELECT gene FROM fix WHERE module = 'grey')", "SELECT cell, tf, round(1 - avg(r), 6) AS score FROM rk JOIN reg USING (gene) WHERE cor > 0.05 AND gene NOT IN (SELECT gene FROM gr) AND tf NOT IN (SELECT gene FROM gr) GROUP BY 1, 2"))
def regulon_scores_without_grey(spark, d):
    return r6(regulation.regulon_scores(emb(spark, d), regs(spark, d), modules=emb_modules(spark, d)), "score")


@query("differential_regulons")
def differential_regulons(spark, d):
    x, r = emb(spark, d), regs(spark, d)
    groups = emb_cells(spark, d).select("cell", (F.col("label") % 2 == 0).alias("first"))
    out = regulation.differential_regulons(regulation.regulon_scores(x, r, "positive", 0.0), regulation.regulon_scores(x, r, "negative", 0.0), x, groups, emb_modules(spark, d), emb_kme(spark, d))
    return r6(out, *[c for c, t in out.dtypes if t == "double"])


@query("motif_overlap", sql(EMB, FIX, MOT, "SELECT module, m.tf AS \"group\", size_module, size_set, coalesce(c, 0) AS size_intersection FROM (SELECT module, count(*) AS size_module FROM fix WHERE module <> 'grey' GROUP BY 1) x CROSS JOIN (SELECT tf, count(*) AS size_set FROM mot GROUP BY 1) m LEFT JOIN (SELECT module, tf, count(*) AS c FROM mot JOIN fix USING (gene) GROUP BY 1, 2) o USING (module, tf)"))
def motif_overlap(spark, d):
    return analysis.overlap_counts(emb_modules(spark, d), motif_table(spark, d), "tf")


# --- plot tables -----------------------------------------------------------------------


@query("module_dot_data", sql(EMB, FIX, MES, GRP, "gm AS (SELECT g, module, avg(me) AS mean, avg(CAST(me > 0 AS INT)) AS frac FROM mes JOIN grp USING (cell) GROUP BY 1, 2)", 'SELECT g AS "group", module, round(mean, 6) + 0.0 AS mean, round(frac, 6) AS frac, round(greatest(-2.5, least(2.5, coalesce((mean - avg(mean) OVER (PARTITION BY module)) / nullif(stddev_samp(mean) OVER (PARTITION BY module), 0), 0))), 6) + 0.0 AS z FROM gm'))
def dot_data(spark, d):
    return r6(plotdata.dot_data(emb_mes(spark, d), emb_cells(spark, d), "label"), "mean", "frac", "z")


@query("module_radar_data", sql(EMB, FIX, MES, GRP, 'SELECT g AS "group", module, round(greatest(avg(me), 0), 6) AS value FROM mes JOIN grp USING (cell) GROUP BY 1, 2'))
def radar_data(spark, d):
    return r6(plotdata.radar_data(emb_mes(spark, d), emb_cells(spark, d), "label"), "value")


MCO = "mp AS (SELECT a.module AS m1, b.module AS m2, coalesce((count(*) * sum(a.me * b.me) - sum(a.me) * sum(b.me)) / nullif(sqrt((count(*) * sum(a.me * a.me) - sum(a.me) * sum(a.me)) * (count(*) * sum(b.me * b.me) - sum(b.me) * sum(b.me))), 0), 0) AS cor FROM mes a JOIN mes b ON a.cell = b.cell AND a.module < b.module GROUP BY 1, 2)"


@query("correlogram_data", sql(EMB, FIX, MES, MCO, "SELECT m1, m2, round(cor, 6) AS cor FROM mp"))
def correlogram(spark, d):
    return r6(modules.module_correlation(emb_mes(spark, d)), "cor")


@query("corr_network_data", sql(EMB, FIX, MES, GRP, MCO, "gm AS (SELECT g, module, round(avg(me), 9) AS m FROM mes JOIN grp USING (cell) GROUP BY 1, 2)", "tp AS (SELECT module, g AS top FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY m DESC, g DESC) AS r FROM gm) WHERE r = 1)", "SELECT m1, m2, round(cor, 6) AS cor, a.top AS top_1, b.top AS top_2 FROM mp JOIN tp a ON a.module = m1 JOIN tp b ON b.module = m2 WHERE abs(cor) >= 0.02"))
def corr_network(spark, d):
    return r6(plotdata.corr_network_data(emb_mes(spark, d), emb_cells(spark, d), "label", modules.module_correlation(emb_mes(spark, d)), 0.02), "cor")


@query("volcano_data")
def volcano(spark, d):
    return r6(plotdata.volcano_data(analysis.find_dmes(emb_mes(spark, d), emb_cells(spark, d), "label")).select("g1", "g2", "module", "avg_log2fc", "neg_log10_p", "label"), "avg_log2fc", "neg_log10_p")


TOME = (pairs_sql("emb"), adj_sql(), tom_sql())


@query("module_network_edges", sql(EMB, FIX, MES, KME, HUB, *TOME, "ed AS (SELECT g1, g2, a.module, tom, row_number() OVER (PARTITION BY a.module ORDER BY round(tom, 9) DESC, g1, g2) AS r FROM tom JOIN hub a ON a.gene = g1 JOIN hub b ON b.gene = g2 AND a.module = b.module)", "SELECT g1, g2, module, round(tom / max(tom) OVER (PARTITION BY module), 6) AS weight FROM ed WHERE r <= 6"))
def network_edges(spark, d):
    return r6(plotdata.network_edges(emb_tom(spark, d), emb_modules(spark, d), emb_hubs(spark, d), 6), "weight")


@query("module_embedding")
def module_embedding(spark, d):
    """Genes in the plane of the two leading components of their overlaps with the hubs."""
    return r6(spectra.embed(plotdata.umap_features(emb_tom(spark, d), emb_hubs(spark, d))), "c0", "c1")


@query("umap_features", sql(EMB, FIX, MES, KME, HUB, *TOME, "SELECT g1 AS gene, g2 AS hub, round(tom, 6) AS tom FROM tom WHERE g2 IN (SELECT gene FROM hub) UNION ALL SELECT g2, g1, round(tom, 6) FROM tom WHERE g1 IN (SELECT gene FROM hub) UNION ALL SELECT gene, gene, 1.0 FROM hub"))
def umap_features(spark, d):
    return r6(plotdata.umap_features(emb_tom(spark, d), emb_hubs(spark, d)), "tom")


@query("topology_heatmap_data", sql(EMB, FIX, MES, KME, *TOME, "rk AS (SELECT gene, CAST(row_number() OVER (ORDER BY round(kme, 9) DESC, gene) AS INT) AS r FROM fix JOIN kme USING (gene, module) WHERE module = 'M1')", "x AS (SELECT a.r AS r1, b.r AS r2, g1, g2, tom FROM tom JOIN rk a ON a.gene = g1 JOIN rk b ON b.gene = g2)", "SELECT r1, r2, g1, g2, round(least(tom, (SELECT quantile_cont(tom, 0.95) FROM x)), 6) AS tom FROM x"))
def topology_heatmap(spark, d):
    return r6(plotdata.topology_heatmap(emb_tom(spark, d), emb_kme(spark, d), emb_modules(spark, d), "M1"), "tom")


@query("hub_heatmap_data", sql(EMB, FIX, MES, KME, HUB, GRP, "sm AS (SELECT cell, g FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42#' || CAST(cell AS VARCHAR)), cell) AS r FROM grp) WHERE r <= 20)", 'SELECT g AS "group", cell, gene, round(greatest(-2.5, least(2.5, (value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene))), 6) + 0.0 AS z FROM emb JOIN sm USING (cell) WHERE gene IN (SELECT gene FROM hub)'))
def hub_heatmap(spark, d):
    return r6(plotdata.hub_heatmap(emb(spark, d), emb_cells(spark, d), "label", emb_hubs(spark, d), 20), "z")


@query("regulon_bars", sql(EMB, MOT, pairs_sql("emb"), EDG, REG, "x AS (SELECT CASE WHEN reg_score > 0 THEN 'positive' ELSE 'negative' END AS side, gene, gain FROM reg WHERE tf = 'g03' AND abs(reg_score) > 0)", "SELECT side, gene, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'positive' THEN -gain ELSE gain END, gene) AS r FROM x) WHERE r <= 3"))
def regulon_bars(spark, d):
    return r6(plotdata.regulon_bars(regs(spark, d), "g03", 3), "gain")


@query("ari_nmi", sql(EMB, FIX, "b AS (SELECT gene, 'N' || CAST(substr(gene, 2) AS INT) % 4 AS module FROM fix)", "x AS (SELECT fix.module AS a, b.module AS b, CAST(count(*) AS DOUBLE) AS c FROM fix JOIN b USING (gene) GROUP BY 1, 2)", "ta AS (SELECT sum(s * (s - 1) / 2) AS p, sum(s * ln(s)) AS l FROM (SELECT a, sum(c) AS s FROM x GROUP BY 1))", "tb AS (SELECT sum(s * (s - 1) / 2) AS p, sum(s * ln(s)) AS l FROM (SELECT b, sum(c) AS s FROM x GROUP BY 1))", "t AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS p, sum(c * ln(c)) AS l FROM x)", "SELECT CAST(n AS BIGINT) AS n, round((t.p - ta.p * tb.p / (n * (n - 1) / 2)) / ((ta.p + tb.p) / 2 - ta.p * tb.p / (n * (n - 1) / 2)), 6) AS ari, round((ln(n) + (t.l - ta.l - tb.l) / n) / ((ln(n) - ta.l / n + ln(n) - tb.l / n) / 2), 6) AS nmi FROM t, ta, tb"))
def ari_nmi(spark, d):
    a = emb_modules(spark, d)
    b = a.select("gene", F.concat(F.lit("N"), (F.substring("gene", 2, 9).cast("int") % 4).cast("string")).alias("module"))
    return r6(plotdata.agreement(a, b), "ari", "nmi")


@query("event_moments", "SELECT event_type, count(*) AS n, round(coalesce((count(*) * sum(value * user_id) - sum(value) * sum(user_id)) / nullif(sqrt((count(*) * sum(value * value) - sum(value) * sum(value)) * (count(*) * sum(CAST(user_id AS DOUBLE) * user_id) - sum(CAST(user_id AS DOUBLE)) * sum(user_id))), 0), 0), 6) AS cor FROM events GROUP BY 1")
def event_moments(spark, d):
    m = moments.windowed_moments(views.read(spark, d, "events"), "value", "user_id", ["event_type"])
    return r6(moments.correlation_of(m, ["event_type"]), "cor")


__all__ = ["QUERIES", "SQL"]
