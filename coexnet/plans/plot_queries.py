"""Queries of the plot tables, of enrichment and of p values, and their SQL; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from coexnet.operators import analysis, features, harmony, modules, network, plotdata, plottables, projection, regulation
from coexnet.plans import catalogue as c
from coexnet.plans.catalogue import EDG, EMB, FIX, FSH, GRP, HUB, KME, MES, MOT, OVL, PRD, PWR, BIN, FIT, REG, RSU, SQL, SUP, TCO, TOME, TRT, pairs_sql, query, r6, sql

# --- p values in SQL ------------------------------------------------------------------


def normal_sql(z: str) -> str:
    """Two-sided tail of the normal distribution: one less the error function, by its series of positive terms."""
    x = f"(greatest({z}, 1e-12) / sqrt(2.0))"
    return f"greatest(0.0, 1 - list_sum([exp((2 * term + 1) * ln({x}) - lgamma(term + 1.5) - {x} * {x}) FOR term IN range(0, 200)]))"


def student_sql(t: str, dof: str) -> str:
    """Two-sided tail of Student's distribution: one less the incomplete beta function, by its hypergeometric series."""
    y, a = f"(greatest({t} * {t}, 1e-24) / ({dof} + {t} * {t}))", f"({dof} / 2.0)"
    front = f"lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5) + ln(2.0) + 0.5 * ln({y}) + {a} * ln(1 - {y})"
    rise = f"lgamma({a} + 0.5 + term) - lgamma({a} + 0.5) - lgamma(1.5 + term) + lgamma(1.5) + term * ln({y})"
    return f"greatest(0.0, 1 - list_sum([exp({front} + {rise}) FOR term IN range(0, 400)]))"


def bh_sql(source: str, name: str, p: str, by: str, tie: str, out: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""{name} AS (SELECT * EXCLUDE (bh_r, bh_m), least(1.0, min(coalesce({p}, 1) * bh_m / bh_r) OVER ({part} ORDER BY bh_r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {out}
  FROM (SELECT *, row_number() OVER ({part} ORDER BY coalesce({p}, 1), {tie}) AS bh_r, count(*) OVER ({part or ""}) AS bh_m FROM {source}))"""


def stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"


EFFECTS = "ef AS (SELECT g1, g2, module, round(avg(CASE WHEN first THEN CAST(me <> 0 AS INT) END), 4) AS pct_1, round(avg(CASE WHEN NOT first THEN CAST(me <> 0 AS INT) END), 4) AS pct_2, avg(CASE WHEN NOT first THEN me END) - avg(CASE WHEN first THEN me END) AS avg_log2fc, count(*) FILTER (first) AS n_1, count(*) FILTER (NOT first) AS n_2 FROM prd GROUP BY 1, 2, 3)"
#: Groups of over 8 cells, so the normal form holds throughout.
WILCOX = f"""zz AS (SELECT g1, g2, module, coalesce((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sqrt(sd2), 0), 0) AS z FROM uu),
wp AS (SELECT ef.*, {normal_sql("z")} AS p_val FROM ef JOIN zz USING (g1, g2, module) WHERE n_1 >= 3 AND n_2 >= 3)"""
WELCH = f"""we AS (SELECT g1, g2, module, avg(me) FILTER (first) AS m1, avg(me) FILTER (NOT first) AS m2, var_samp(me) FILTER (first) / count(*) FILTER (first) AS s1, var_samp(me) FILTER (NOT first) / count(*) FILTER (NOT first) AS s2, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2 FROM prd GROUP BY 1, 2, 3),
wt AS (SELECT g1, g2, module, (m1 - m2) / sqrt(s1 + s2) AS t, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS df FROM we),
wp AS (SELECT ef.*, {student_sql("t", "df")} AS p_val FROM ef JOIN wt USING (g1, g2, module))"""
DME = "SELECT g1, g2, module, pct_1, pct_2, round(avg_log2fc, 6) + 0.0 AS avg_log2fc, n_1, n_2, round(p_val, 6) + 0.0 AS p_val, round(p_val_adj, 6) + 0.0 AS p_val_adj FROM dm"
DMW = (EFFECTS, RSU, WILCOX, bh_sql("wp", "dm", "p_val", "g1, g2", "module", "p_val_adj"))
VOLCANO = "SELECT g1, g2, module, round(avg_log2fc, 6) + 0.0 AS avg_log2fc, round(-log10(CASE WHEN p_val > 0 THEN p_val ELSE (SELECT min(p_val) FROM dm WHERE p_val > 0) END), 6) + 0.0 AS neg_log10_p, CASE WHEN p_val_adj < 0.05 THEN module ELSE '' END AS label FROM dm"

SQL["dme_wilcox"] = sql(EMB, FIX, MES, GRP, PRD, *DMW, DME)
SQL["dme_ttest"] = sql(EMB, FIX, MES, GRP, PRD, EFFECTS, WELCH, bh_sql("wp", "dm", "p_val", "g1, g2", "module", "p_val_adj"), DME)
SQL["volcano_data"] = sql(EMB, FIX, MES, GRP, PRD, *DMW, VOLCANO)

TCOR = "tc AS (" + TCO.format("tm").replace("round(coalesce(", "(coalesce(").replace(", 0), 6) AS cor", ", 0)) AS cor") + ")"
TRAIT_P = f"tp AS (SELECT *, {student_sql('(cor * sqrt((n - 2) / greatest(1 - cor * cor, 1e-300)))', '(n - 2)')} AS pval FROM tc)"
TRF = (TRT, TCOR, TRAIT_P, bh_sql("tp", "tf", "pval", "trait", "module", "fdr"))
SQL["trait_cor_pvalue"] = sql(EMB, FIX, MES, *TRF, "SELECT trait, module, n, round(cor, 6) + 0.0 AS cor, round(pval, 6) + 0.0 AS pval, round(fdr, 6) + 0.0 AS fdr FROM tf")


# --- enrichment -------------------------------------------------------------------------


def fisher_sql(source: str, name: str, keys: str, universe: int = 64) -> str:
    """Overlap rows (keys, size_module, size_set, a) with pval and the figures made of it."""
    n = universe
    return f"""{name} AS (SELECT {keys}, any_value(m) AS m, any_value(k) AS k, any_value(a) AS a, least(1.0, sum(exp(lm.v - li.v - lmi.v + lo.v - lki.v - lr.v - (ln_.v - lk.v - lnk.v)))) AS pval
  FROM (SELECT {keys}, size_module AS m, size_set AS k, a, unnest(range(greatest(a, size_module + size_set - {n}, 0), least(size_module, size_set) + 1)) AS i FROM {source}) hy
  JOIN lf lm ON lm.i = hy.m JOIN lf li ON li.i = hy.i JOIN lf lmi ON lmi.i = hy.m - hy.i JOIN lf lo ON lo.i = {n} - hy.m JOIN lf lki ON lki.i = hy.k - hy.i JOIN lf lr ON lr.i = {n} - hy.m - hy.k + hy.i JOIN lf ln_ ON ln_.i = {n} JOIN lf lk ON lk.i = hy.k JOIN lf lnk ON lnk.i = {n} - hy.k GROUP BY {keys})"""


def combined_sql(n: int = 64) -> str:
    return f"-ln(greatest(pval, 1e-300)) * CASE WHEN (m - a) * (k - a) > 0 THEN a * ({n}.0 - m - k + a) / nullif((m - a) * (k - a), 0) ELSE (a + 0.5) * ({n} - m - k + a + 0.5) / ((m - a + 0.5) * (k - a + 0.5)) END"


LF = FSH.split(", hy AS")[0]
OVF = (OVL, LF, fisher_sql("ov", "fp", "module, g"), bh_sql("fp", "en", "pval", "", "module, g", "fdr"))
SQL["ora_enrichment"] = sql(EMB, FIX, *OVF, f"""SELECT 'hash' AS library, g AS term, module, m AS size_module, k AS size_set, a AS size_intersection, round(a * (64.0 - m - k + a) / nullif((m - a) * (k - a), 0), 6) + 0.0 AS odds_ratio,
  round(a * (64.0 - m - k + a) / (m * k), 6) + 0.0 AS odds_ratio_marginal, round(a / CAST(m + k - a AS DOUBLE), 6) + 0.0 AS jaccard, round(pval, 6) + 0.0 AS pval, round(fdr, 6) + 0.0 AS fdr, {stars_sql("fdr")} AS significance, round({combined_sql()}, 6) + 0.0 AS combined_score FROM en WHERE a > 0""")


def term_sets(spark, d):
    return c.gene_sets(spark, d).select(F.lit("hash").alias("library"), F.col("group").alias("term"), "gene")


@query("enrichment_plot_data", sql(EMB, FIX, *OVF, f"cs AS (SELECT *, {combined_sql()} AS cs FROM en WHERE a > 0)", "ps AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(cs, 9) DESC, g) AS place FROM cs)", "SELECT module, 'hash' AS library, g AS term, round(-log10(pval), 6) + 0.0 AS neg_log10_p, round(a / CAST(k AS DOUBLE), 6) AS gene_ratio, round(greatest(20.0, least(300.0, a * 200.0 / max(a) OVER (PARTITION BY module) + 20)), 6) AS size, CAST(place AS INT) AS place FROM ps WHERE place <= 3"))
def enrichment_plot(spark, d):
    return r6(plottables.enrichment_plot(analysis.enrichment(c.emb_modules(spark, d), term_sets(spark, d)), 3), "neg_log10_p", "gene_ratio", "size")


RGE = """tg AS (SELECT DISTINCT tf, CASE WHEN cor > 0 THEN 'positive' WHEN cor < 0 THEN 'negative' END AS side, gene FROM reg WHERE cor <> 0),
re AS (SELECT tf, side, g, max(n) AS size_module, max(s.k) AS size_set, count(*) AS a FROM tg JOIN (SELECT tf, side, count(*) AS n FROM tg GROUP BY 1, 2 HAVING count(*) >= 5) z USING (tf, side) JOIN st USING (gene) JOIN (SELECT g, count(*) AS k FROM st GROUP BY 1) s USING (g) GROUP BY 1, 2, 3)"""


@query("regulon_enrichment", sql(EMB, FIX, MOT, pairs_sql("emb"), EDG, REG, OVL, LF, RGE, fisher_sql("re", "fp", "tf, side, g"), bh_sql("fp", "en", "pval", "tf, side", "g", "fdr"), f"SELECT tf, side AS target_type, 'hash' AS library, g AS term, m AS size_module, k AS size_set, a AS size_intersection, round(pval, 6) + 0.0 AS pval, round(fdr, 6) + 0.0 AS fdr, round({combined_sql()}, 6) + 0.0 AS combined_score FROM en"))
def regulon_enrichment(spark, d):
    return r6(analysis.enrich_regulons(c.regs(spark, d), c.emb_modules(spark, d), term_sets(spark, d)), "pval", "fdr", "combined_score")


# --- preservation -----------------------------------------------------------------------

PRS = """gn AS (SELECT DISTINCT gene FROM fix), sz AS (SELECT module, count(*) AS n FROM fix WHERE module <> 'grey' GROUP BY 1),
ob AS (SELECT a.module, 2 * sum(tom) AS observed FROM tom JOIN fix a ON a.gene = g1 JOIN fix b ON b.gene = g2 AND a.module = b.module GROUP BY 1),
dr AS (SELECT module, draw, gene, n, row_number() OVER (PARTITION BY module, draw ORDER BY md5('42#' || draw || '#' || module || '#' || gene), gene) AS r FROM sz, gn, range(1, 101) t(draw)),
pk AS (SELECT module, draw, gene FROM dr WHERE r <= n),
nl AS (SELECT module, avg(s) AS mean, stddev_pop(s) AS sd FROM (SELECT a.module, a.draw, 2 * sum(tom) AS s FROM tom JOIN pk a ON a.gene = g1 JOIN pk b ON b.gene = g2 AND a.module = b.module AND a.draw = b.draw GROUP BY 1, 2) GROUP BY 1),
tw AS (SELECT g1 AS i, g2 AS j, tom FROM tom UNION ALL SELECT g2, g1, tom FROM tom UNION ALL SELECT gene, gene, 1.0 FROM gn),
mr AS (SELECT module, median(m) AS median_rank FROM (SELECT a.module, i, median(tom) AS m FROM tw JOIN fix a ON a.gene = i JOIN fix b ON b.gene = j AND a.module = b.module GROUP BY 1, 2) GROUP BY 1),
pz AS (SELECT module, n AS n_genes, observed, mean, sd, coalesce((observed - mean) / nullif(sd, 0), 0) AS z FROM sz JOIN ob USING (module) JOIN nl USING (module)),
pv AS (SELECT module, n_genes, observed, mean, sd, z AS z_summary, median_rank, CASE WHEN z >= 10 THEN 'highly preserved' WHEN z >= 5 THEN 'moderately preserved' WHEN z >= 2 THEN 'weakly preserved' ELSE 'non-preserved' END AS preservation FROM pz JOIN mr USING (module))"""
SQL["module_preservation"] = sql(EMB, FIX, *TOME, PRS, "SELECT module, n_genes, round(observed, 6) + 0.0 AS observed, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(z_summary, 6) + 0.0 AS z_summary, round(median_rank, 6) + 0.0 AS median_rank, preservation FROM pv")


@query("preservation_plot_data", sql(EMB, FIX, *TOME, PRS, "SELECT module, round(z_summary, 6) + 0.0 AS z_summary, preservation, CAST(row_number() OVER (ORDER BY round(z_summary, 9), module) AS INT) AS place FROM pv"))
def preservation_plot(spark, d):
    return r6(plottables.preservation_plot(projection.preservation(c.emb_tom(spark, d), c.emb_modules(spark, d))), "z_summary")


# --- networks and bars --------------------------------------------------------------------


@query("soft_power_plot_data", sql(SUP, pairs_sql("sup"), PWR, BIN, FIT, "SELECT power, round(r2, 6) AS sft_r_sq, round(avg(k), 6) AS mean_k, power = coalesce((SELECT min(power) FROM ft WHERE r2 >= 0.85), (SELECT max(power) FROM ft)) AS selected FROM ft JOIN kk USING (power) GROUP BY 1, r2"))
def soft_power_plot(spark, d):
    return r6(plottables.soft_power_plot(network.power_table(c.sup_pairs(spark, d))).select("power", "sft_r_sq", "mean_k", "selected"), "sft_r_sq", "mean_k")


@query("kme_plot_data", sql(EMB, FIX, MES, KME, HUB, "SELECT module, gene, round(kme, 6) AS kme, CAST(row_number() OVER (PARTITION BY module ORDER BY rank DESC) AS INT) AS place FROM hub"))
def kme_plot(spark, d):
    return r6(plottables.kme_plot(c.emb_modules(spark, d), c.emb_kme(spark, d), 5), "kme")


def scaled_sql(source: str, share: str, constant: str) -> str:
    return f"""kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(tom, 9) DESC, g1, g2) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY kind) * {share}, 0)) AS n FROM {source}) WHERE r <= n)
SELECT g1, g2, kind, round(tom, 6) AS tom, round(coalesce((tom - min(tom) OVER (PARTITION BY kind)) / nullif(max(tom) OVER (PARTITION BY kind) - min(tom) OVER (PARTITION BY kind), 0), {constant}), 6) AS weight FROM kp"""


HNE = """hb AS (SELECT module, gene FROM hub WHERE rank <= 2), nd AS (SELECT * FROM hb UNION ALL SELECT module, gene FROM (SELECT module, gene, row_number() OVER (PARTITION BY module ORDER BY md5('42#' || gene), gene) AS r FROM fix WHERE module <> 'grey' AND gene NOT IN (SELECT gene FROM hb)) WHERE r <= 3),
xe AS (SELECT g1, g2, tom, a.module AS m1, b.module AS m2 FROM tom JOIN nd a ON a.gene = g1 JOIN nd b ON b.gene = g2),
he AS (SELECT g1, g2, m1 AS kind, tom FROM xe WHERE m1 = m2 UNION ALL (SELECT g1, g2, 'between', tom FROM xe WHERE m1 <> m2 ORDER BY round(tom, 9) DESC, g1, g2 LIMIT 21))"""


@query("hub_network_edges", sql(EMB, FIX, MES, KME, HUB, *TOME, HNE, *scaled_sql("he", "0.5", "1.0").split("\n", 1)))
def hub_network(spark, d):
    return r6(plottables.hub_network_edges(c.emb_tom(spark, d), c.emb_modules(spark, d), c.emb_kme(spark, d), 2, 3), "tom", "weight")


UME = """tw AS (SELECT g1, g2, tom FROM tom UNION ALL SELECT g2, g1, tom FROM tom),
ue AS (SELECT g1, g2, CASE WHEN a.module = b.module THEN a.module ELSE 'between' END AS kind, tom FROM tw JOIN fix a ON a.gene = g1 JOIN fix b ON b.gene = g2 WHERE tom > 0 AND a.module <> 'grey' AND b.module <> 'grey' AND g2 IN (SELECT gene FROM hub))"""


@query("umap_edges", sql(EMB, FIX, MES, KME, HUB, *TOME, UME, *scaled_sql("ue", "0.2", "0.5").split("\n", 1)))
def umap_edges(spark, d):
    return r6(plottables.umap_edges(c.emb_tom(spark, d), c.emb_modules(spark, d), c.emb_hubs(spark, d)), "tom", "weight")


@query("lollipop_data", sql(EMB, FIX, MES, GRP, PRD, *DMW, "SELECT g1, g2, module, round(avg_log2fc, 6) + 0.0 AS avg_log2fc, CAST(row_number() OVER (PARTITION BY g1, g2 ORDER BY round(avg_log2fc, 9), module) AS INT) AS place, p_val < 0.05 AS significant, round(ln(2), 6) AS size FROM dm"))
def lollipop(spark, d):
    return r6(plottables.lollipop(analysis.find_dmes(c.emb_mes(spark, d), c.emb_cells(spark, d), "label")), "avg_log2fc", "size")


@query("trait_heat_data", sql(EMB, FIX, MES, *TRF, f"SELECT trait, module, round(greatest(-0.05, least(0.05, cor)), 6) + 0.0 AS cor, {stars_sql('pval')} AS label FROM tf"))
def trait_heat(spark, d):
    cor = analysis.trait_correlation(c.emb_mes(spark, d), c.trait_cells(spark, d), ["g07", "g15", "g23"])
    return r6(plottables.trait_heat(analysis.trait_p_values(cor), "pval", 0.05), "cor")


OVV = "vv AS (SELECT module, g, ln(greatest(a * (64.0 - size_module - size_set + a) / nullif((size_module - a) * (size_set - a), 0), 1e-300)) AS value FROM ov)"


@query("overlap_plot_data", sql(EMB, FIX, OVL, OVV.replace("greatest(a", "greatest((a").replace(", 0), 1e-300)", ", 0)), 1e-300)"), 'SELECT module, g AS "group", round(value, 6) + 0.0 AS value, 0.0 AS "limit", CAST(row_number() OVER (PARTITION BY g ORDER BY round(value, 9) NULLS LAST, module) AS INT) AS place FROM vv'))
def overlap_plot(spark, d):
    x = analysis.overlap_test(analysis.overlap_counts(c.emb_modules(spark, d), c.gene_sets(spark, d)), c.emb_modules(spark, d).count())
    return r6(plottables.overlap_plot(x), "value", "limit")


@query("motif_bars", sql(EMB, FIX, MOT, "oo AS (SELECT module, m.tf, size_module AS s, size_set AS k, coalesce(c, 0) AS a FROM (SELECT module, count(*) AS size_module FROM fix WHERE module <> 'grey' GROUP BY 1) x CROSS JOIN (SELECT tf, count(*) AS size_set FROM mot GROUP BY 1) m LEFT JOIN (SELECT module, tf, count(*) AS c FROM mot JOIN fix USING (gene) GROUP BY 1, 2) o USING (module, tf))", "ro AS (SELECT module, tf, a * (64.0 - s - k + a) / nullif((s - a) * (k - a), 0) AS o FROM oo)", "pl AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY round(o, 9) DESC NULLS LAST, tf) AS r FROM ro)", 'SELECT module, tf AS "group", round(o, 6) + 0.0 AS odds_ratio, CAST(r AS INT) AS place FROM pl WHERE r <= 4'))
def motif_bars(spark, d):
    m = c.emb_modules(spark, d)
    return r6(plottables.motif_bars(analysis.overlap_test(analysis.overlap_counts(m, c.motif_table(spark, d), "tf"), m.count()), 4), "odds_ratio")


@query("topology_bars", sql(EMB, FIX, MES, KME, "x AS (SELECT gene, kme FROM fix JOIN kme USING (gene, module) WHERE module = 'M1')", "SELECT gene, round(kme, 6) AS value, CAST(row_number() OVER (ORDER BY round(kme, 9) DESC, gene) AS INT) AS place, round(greatest(0.1, least(1.0, abs(kme) / max(abs(kme)) OVER ())), 6) AS alpha FROM x"))
def topology_bars(spark, d):
    return r6(plottables.topology_bars(c.emb_modules(spark, d), c.emb_kme(spark, d), "M1"), "value", "alpha")


TFN = """s1 AS (SELECT tf, gene FROM reg WHERE tf IN ('g03', 'g05')), f2 AS (SELECT 'g03' AS tf UNION SELECT 'g05' UNION SELECT gene FROM s1), s2 AS (SELECT tf, gene FROM reg WHERE tf IN (SELECT tf FROM f2)),
ds AS (SELECT gene, min(d) AS d FROM (SELECT gene, 1 AS d FROM s1 UNION ALL SELECT gene, 2 FROM s2) GROUP BY 1),
dg AS (SELECT tf AS gene, count(DISTINCT gene) AS n FROM reg GROUP BY 1)"""


@query("tf_network_edges", sql(EMB, MOT, pairs_sql("emb"), EDG, REG, TFN, "SELECT tf, gene, round(greatest(-0.75, least(0.75, cor)), 6) + 0.0 AS weight, CAST(CASE WHEN gene IN ('g03', 'g05') THEN 0 ELSE d END AS INT) AS depth, coalesce(n, 0) AS degree FROM s2 JOIN reg USING (tf, gene) JOIN ds USING (gene) LEFT JOIN dg USING (gene) WHERE abs(cor) >= 0.01"))
def tf_network_edges(spark, d):
    return r6(plottables.tf_network_edges(c.regs(spark, d), ["g03", "g05"]), "weight")


MRN = SQL["module_regulatory_network"]
NET = MRN.replace("\nSELECT s.module AS source", ",\nnet AS (SELECT s.module AS source") + ")\n"


def net(spark, d):
    return regulation.module_regulation(c.regs(spark, d), c.emb_modules(spark, d))


@query("regulatory_edges", NET + "SELECT source, target, round(greatest(-1.0, least(1.0, score_pos - score_neg)), 5) + 0.0 AS score FROM net WHERE abs(greatest(-1.0, least(1.0, score_pos - score_neg))) >= 0.4 AND source <> target")
def regulatory_edges(spark, d):
    return plottables.regulatory_edges(net(spark, d), least=0.4, loops=False).withColumn("score", F.round("score", 5) + F.lit(0.0))


@query("regulatory_heat_data", NET + "SELECT source, target, round(least(1.0, score_pos), 5) + 0.0 AS score, CASE WHEN n_pos >= 2 THEN CAST(n_pos AS VARCHAR) ELSE '' END AS label FROM net")
def regulatory_heat(spark, d):
    return plottables.regulatory_heat(net(spark, d), "positive", least_label=2).withColumn("score", F.round("score", 5) + F.lit(0.0))


# --- differential regulons ------------------------------------------------------------------


def tagged_sql(tag: str, rows: str) -> str:
    """Test of (cell, tf, score) rows between even and odd labels, as in ``differential_regulons``."""
    return f"""{tag}_x AS (SELECT cell, tf, score, CAST(label AS INT) % 2 = 0 AS first FROM ({rows}) JOIN (SELECT vec_id AS cell, label FROM embeddings) USING (cell)),
{tag}_k AS (SELECT tf, first, score, rank() OVER (PARTITION BY tf ORDER BY score) + (count(*) OVER (PARTITION BY tf, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY tf, score) AS t FROM {tag}_x),
{tag}_u AS (SELECT tf, CAST(count(*) FILTER (first) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT first) AS DOUBLE) AS n2, sum(CASE WHEN first THEN rk ELSE 0 END) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS tt, avg(score) FILTER (first) - avg(score) FILTER (NOT first) AS fold FROM {tag}_k GROUP BY 1),
{tag}_z AS (SELECT tf, fold, coalesce((greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))), 0), 0) AS z FROM {tag}_u),
{tag}_p AS (SELECT tf, fold, {normal_sql("z")} AS p FROM {tag}_z),
{bh_sql(tag + "_p", tag, "p", "", "tf", "adj")}"""


RKS = "rks AS (SELECT cell, gene, (row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) - 1) / 63.0 AS r FROM emb)"
DRG = (
    EMB, FIX, MES, KME, MOT, pairs_sql("emb"), EDG, REG, RKS,
    tagged_sql("positive", "SELECT cell, tf, round(1 - avg(r), 12) AS score FROM rks JOIN reg USING (gene) WHERE cor > 0 GROUP BY 1, 2"),
    tagged_sql("negative", "SELECT cell, tf, round(1 - avg(r), 12) AS score FROM rks JOIN reg USING (gene) WHERE cor < 0 GROUP BY 1, 2"),
    tagged_sql("deg", "SELECT cell, gene AS tf, value AS score FROM emb WHERE gene IN (SELECT tf FROM reg WHERE cor > 0)"),
    "best AS (SELECT gene AS tf, max(kme) AS kme FROM kme GROUP BY 1)",
    "dr AS (SELECT tf, " + ", ".join(f"{t}.p AS p_val_{t}, {t}.fold AS avg_log2fc_{t}, {t}.adj AS p_val_adj_{t}" for t in ("positive", "negative", "deg")) + ", module, kme FROM positive JOIN negative USING (tf) LEFT JOIN deg USING (tf) LEFT JOIN fix ON fix.gene = tf LEFT JOIN best USING (tf))",
)
SQL["differential_regulons"] = sql(*DRG, "SELECT tf, module, round(kme, 6) + 0.0 AS kme, " + ", ".join(f"round({f}_{t}, 6) + 0.0 AS {f}_{t}" for f in ("p_val", "avg_log2fc", "p_val_adj") for t in ("positive", "negative", "deg")) + " FROM dr")


def given_regulons(spark, d):
    """Made of hashes: changes and p values of the ten regulators, so that all cases of the plot occur."""
    g = c.emb(spark, d).select("gene").distinct()
    share = lambda tag: regulation.hash_share(F.lit(tag), F.col("tf"))
    return g.select(F.col("gene").alias("tf")).select("tf", *((share(f"f{t}") - 0.5).alias(f"avg_log2fc_{t}") for t in ("positive", "negative", "deg")), *((share(f"p{t}") * 0.1).alias(f"p_val_adj_{t}") for t in ("positive", "negative", "deg")))


def share_sql(tag: str) -> str:
    return f"('0x' || substr(md5('{tag}#' || gene), 1, 8))::BIGINT / 4294967296.0"


GVN = "gv AS (SELECT gene AS tf, " + ", ".join(f"{share_sql('f' + t)} - 0.5 AS f_{t}, {share_sql('p' + t)} * 0.1 AS p_{t}" for t in ("positive", "negative", "deg")) + " FROM (SELECT DISTINCT gene FROM emb))"
GVS = "gs AS (SELECT *, ((f_positive < 0 AND f_negative > 0) OR (f_positive > 0 AND f_negative < 0)) AND (p_positive <= 0.05 OR p_negative <= 0.05) AS sig FROM gv)"


@query("regulon_scatter_data", sql(EMB, GVN, GVS, """SELECT tf, round(f_positive, 6) + 0.0 AS x, round(f_negative, 6) + 0.0 AS y, sig AS significant, abs(f_deg) >= 0.1 AND p_deg < 0.05 AS is_deg, CASE WHEN f_negative > 0 THEN 'top-' ELSE 'bottom-' END || CASE WHEN f_positive > 0 THEN 'right' ELSE 'left' END AS quadrant,
  sig AND least(row_number() OVER (PARTITION BY sig ORDER BY round(f_positive, 9) DESC, tf), row_number() OVER (PARTITION BY sig ORDER BY round(f_positive, 9), tf)) <= 4 AS labelled FROM gs"""))
def regulon_scatter(spark, d):
    x = plottables.differential_regulon_plot(given_regulons(spark, d), n_label=4)
    return r6(x.select("tf", F.col("avg_log2fc_positive").alias("x"), F.col("avg_log2fc_negative").alias("y"), "significant", "is_deg", "quadrant", "labelled"), "x", "y")


@query("regulon_line", sql(EMB, GVN, "SELECT count(*) AS n, round(covar_pop(f_negative, f_positive) / var_pop(f_positive), 6) + 0.0 AS slope, round(avg(f_negative) - covar_pop(f_negative, f_positive) / var_pop(f_positive) * avg(f_positive), 6) + 0.0 AS intercept FROM gv"))
def regulon_line(spark, d):
    return r6(plottables.regulon_line(given_regulons(spark, d)), "slope", "intercept")


# --- small ones -------------------------------------------------------------------------------


@query("centroids", 'SELECT CAST(label AS VARCHAR) AS "group", round(avg(CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) + 0.0 AS y FROM embeddings GROUP BY 1')
def centroids(spark, d):
    return r6(plottables.centroids(c.emb_coords(spark, d), c.emb_cells(spark, d), "label"), "x", "y")


@query("gene_flagged", sql(EMB, "SELECT DISTINCT gene FROM emb WHERE CAST(substr(gene, 2) AS INT) % 3 = 0"))
def gene_flagged(spark, d):
    flags = c.emb(spark, d).select("gene").distinct().withColumn("highly_variable", F.substring("gene", 2, 9).cast("int") % 3 == 0)
    return features.gene_flagged(c.emb(spark, d), flags)


@query("feature_plot_data", sql(EMB, FIX, MES, "SELECT module, cell, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS y, round(me, 6) + 0.0 AS value, round(max(abs(me)) OVER (PARTITION BY module), 6) AS \"limit\" FROM mes JOIN (SELECT vec_id AS cell, embedding FROM embeddings) USING (cell)"))
def feature_plot(spark, d):
    return r6(plotdata.feature_plot_data(c.emb_mes(spark, d), c.emb_coords(spark, d)), "x", "y", "value", "limit")


@query("harmony_eigengenes")
def harmony_eigengenes(spark, d):
    """No SQL: rounds of soft clustering, tested against plain numpy."""
    z = modules.component_scores(c.emb(spark, d), c.emb_modules(spark, d), features.count_cells(c.emb(spark, d)))
    return r6(harmony.harmony(z, c.emb_cells(spark, d), ["label"]).select("cell", "module", F.col("z")[0].alias("me")), "me")
