"""Queries of trees and of the orders that follow from them, and SQL that grows the same trees step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from coexnet.operators import clustering, features, network, plottables
from coexnet.plans import catalogue as c
from coexnet.plans.catalogue import BIN, EMB, FIT, FIX, MCO, MES, PWR, SQL, SUP, adj_sql, pairs_sql, query, r6, sql, tom_sql
from coexnet.plans.plot_queries import NET, net, student_sql


def tree_sql(source: str, method: str = "average", name: str = "st") -> str:
    """Steps of the tree over ``source`` (g1, g2, s): the state is a list of clusters, whose members stand in the order of leaves.

    ``average`` takes similarities, ``ward`` squared distances. Each step tries all pairs of clusters, adding up their members' pairs;
    equal heights are told apart by the clusters' first leaves.
    """
    total = lambda x, y: f"coalesce(list_sum(flatten([[d[p * n + q + 1] FOR q IN {y}.m] FOR p IN {x}.m])), 0.0)"
    size = lambda x: f"CAST(len({x}.m) AS DOUBLE)"
    mean = f"{total('x', 'y')} / ({size('x')} * {size('y')})"
    inside = lambda x: f"{total(x, x)} / 2 / ({size(x)} * {size(x)})"
    height = f"1 - {mean}" if method == "average" else f"sqrt(round(2 * {size('x')} * {size('y')} / ({size('x')} + {size('y')}) * greatest(0.0, {mean} - {inside('x')} - {inside('y')}), 12))"
    return f"""{name}_n AS (SELECT g, CAST(row_number() OVER (ORDER BY g) - 1 AS INT) AS id FROM (SELECT g1 AS g FROM {source} UNION SELECT g2 FROM {source})),
{name}_d AS (SELECT list(coalesce(s, 0.0) ORDER BY a.id, b.id) AS d, CAST(max(a.id) + 1 AS INT) AS n FROM {name}_n a CROSS JOIN {name}_n b LEFT JOIN (SELECT g1, g2, s FROM {source} UNION ALL SELECT g2, g1, s FROM {source}) p ON p.g1 = a.g AND p.g2 = b.g),
{name}(step, n, d, c, best) AS (
  SELECT -1, n, d, [{{'id': CAST(i AS INT), 'm': [CAST(i AS INT)]}} FOR i IN range(n)], {{'h': 0.0::DOUBLE, 'a': 0, 'b': 0, 'i': 0, 'j': 0, 'm': [0]}} FROM {name}_d
  UNION ALL
  SELECT step + 1, n, d, list_append([x FOR x IN c IF x.id <> best.i AND x.id <> best.j], {{'id': n + step + 1, 'm': best.m}}), best
  FROM (SELECT step, n, d, c, list_sort(flatten([[{{'h': CAST({height} AS DOUBLE), 'a': list_min(x.m), 'b': list_min(y.m), 'i': least(x.id, y.id), 'j': greatest(x.id, y.id), 'm': CASE WHEN x.id < y.id THEN list_concat(x.m, y.m) ELSE list_concat(y.m, x.m) END}} FOR y IN c IF list_min(x.m) < list_min(y.m)] FOR x IN c]))[1] AS best FROM {name} WHERE len(c) > 1))"""


def recursive(*parts: str) -> str:
    return sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


MERGES = "SELECT CAST(step AS INT) AS step, CAST(best.i AS INT) AS \"left\", CAST(best.j AS INT) AS \"right\", round(best.h, 6) + 0.0 AS height, CAST(len(best.m) AS INT) AS size FROM {0} WHERE step >= 0"
PLACES = "SELECT g AS gene, CAST(list_position(best.m, id) - 1 AS INT) AS place FROM {0} JOIN {0}_n ON true WHERE len(c) = 1"

SQL["linkage"] = recursive(SUP, pairs_sql("sup"), adj_sql(), tom_sql(), "pr AS (SELECT g1, g2, tom AS s FROM tom)", tree_sql("pr"), MERGES.format("st"))


@query("leaf_order", recursive(SUP, pairs_sql("sup"), adj_sql(), tom_sql(), "pr AS (SELECT g1, g2, tom AS s FROM tom)", tree_sql("pr"), PLACES.format("st")))
def leaf_order(spark, d):
    return clustering.leaf_order(c.sup_tom(spark, d))


# --- order of the regulatory heat map ---------------------------------------------------

HEAT = NET.rstrip() + """,
ht AS (SELECT source, target, least(1.0, score_pos) AS score FROM net),
sqr AS (SELECT a.target AS g1, b.target AS g2, sum((a.score - b.score) * (a.score - b.score)) AS s FROM ht a JOIN ht b ON a.source = b.source AND a.target < b.target GROUP BY 1, 2)"""


def heat(spark, d):
    return plottables.regulatory_heat(net(spark, d).withColumn("score_pos", F.round("score_pos", 6)), "positive")


@query("regulatory_heat_linkage", f"{HEAT},\n{tree_sql('sqr', 'ward')}\n{MERGES.format('st')}".replace("WITH ", "WITH RECURSIVE ", 1))
def regulatory_heat_linkage(spark, d):
    x = heat(spark, d).select(F.col("target").alias("gene"), F.col("source").alias("cell"), F.col("score").alias("value"))
    return r6(clustering.linkage(clustering.row_distances(x), "square", "ward"), "height")


@query("regulatory_heat_order", f"{HEAT},\n{tree_sql('sqr', 'ward')}\n{PLACES.format('st')}".replace("WITH ", "WITH RECURSIVE ", 1))
def regulatory_heat_order(spark, d):
    return plottables.regulatory_heat_order(heat(spark, d))


# --- correlogram ------------------------------------------------------------------------


@query("correlogram_ordered", recursive(EMB, FIX, MES, MCO, "pr AS (SELECT m1 AS g1, m2 AS g2, cor AS s FROM mp)", tree_sql("pr"), f"pl AS ({PLACES.format('st')})", "nn AS (SELECT CAST(count(*) - 2 AS DOUBLE) AS dof FROM embeddings)",
    f"SELECT m1, m2, round(cor, 6) + 0.0 AS cor, round({student_sql('(cor * sqrt(dof / (1 - cor * cor)))', 'dof')}, 6) + 0.0 AS p, a.place AS place1, b.place AS place2 FROM mp JOIN pl a ON a.gene = m1 JOIN pl b ON b.gene = m2 CROSS JOIN nn"))
def correlogram_ordered(spark, d):
    return r6(plottables.correlogram(c.emb_mes(spark, d), "hclust"), "cor", "p")


# --- merging of modules by their scores -------------------------------------------------

SQL["module_merge"] = recursive(
    EMB, FIX, MES, MCO, "pr AS (SELECT m1 AS g1, m2 AS g2, cor AS s FROM mp)", tree_sql("pr"),
    "cl AS (SELECT unnest([[q FOR q IN x.m] FOR x IN c]) AS m FROM st WHERE step = (SELECT max(step) FROM st WHERE step < 0 OR best.h <= 0.9))",
    "nw AS (SELECT unnest(m) AS id, list_min(m) AS lead FROM cl)", "mg AS (SELECT a.g AS module, b.g AS merged FROM nw JOIN st_n a ON a.id = nw.id JOIN st_n b ON b.id = lead)",
    "SELECT gene, coalesce(merged, module) AS module FROM fix LEFT JOIN mg USING (module)",
)


# --- selection and fit ------------------------------------------------------------------


@query("gene_flagged_first", sql(EMB, "SELECT gene FROM (SELECT DISTINCT gene FROM emb WHERE CAST(substr(gene, 2) AS INT) % 3 = 0) ORDER BY CAST(substr(gene, 2) AS INT) * 37 % 64, gene LIMIT 10"))
def gene_flagged_first(spark, d):
    """The first ten flagged genes in an order of their own, as selection by flags with a number does."""
    i = F.substring("gene", 2, 9).cast("int")
    flags = c.emb(spark, d).select("gene").distinct().withColumns({"highly_variable": i % 3 == 0, "place": i * 37 % 64})
    return features.gene_flagged(c.emb(spark, d), flags, n_genes=10, place="place")


@query("scale_free_fit_rest", sql(SUP, pairs_sql("sup"), PWR, BIN, FIT.replace("FROM bins)", "FROM bins WHERE bin > 0)"), "SELECT power, round(r2, 6) + 0.0 AS sft_r_sq, round(slope, 6) + 0.0 AS slope FROM ft"))
def scale_free_fit_rest(spark, d):
    """The fit without the bin of the least connectivity."""
    k = network.powered_degrees(c.sup_pairs(spark, d))
    return r6(network.scale_free_fit(k, remove_first=True).select("power", "sft_r_sq", "slope"), "sft_r_sq", "slope")
