import numpy as np
import pytest
from pyspark.sql import functions as F

from coexnet.functions import stats
from coexnet.operators import analysis, correlation, features, plottables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tiled_products(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.6, (23, 57)).astype(float)
    expr = spark.createDataFrame([(j, f"g{i:02d}", float(x[i, j])) for i in range(23) for j in range(57) if x[i, j]], "cell long, gene string, value double")
    want = x @ x.T
    for chunk, block in ((10, 4), (1000, 5), (7, 100), (1000, 1000)):
        got = {(r["g1"], r["g2"]): r["sxy"] for r in correlation._products_blocked(expr, chunk, block).collect()}
        full = {(f"g{i:02d}", f"g{j:02d}"): want[i, j] for i in range(23) for j in range(i + 1, 23) if x[i].any() and x[j].any()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in full.items() if v} and all(a < b for a, b in got)
    assert correlation._products_blocked(expr.limit(0), 10, 4).count() == 0


def test_scale01(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)], "k string, v double")
    assert rows(stats.scale01(df, ["k"], "v", "s", 0.5), "k", "v", "s") == [("a", 1.0, 0.0), ("a", 2.0, 0.5), ("a", 3.0, 1.0), ("b", 5.0, 0.5), ("b", 5.0, 0.5)]


def test_soft_power_plot(spark):
    t = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.95)], "power int, sft_r_sq double")
    chosen = lambda x: [r["power"] for r in x.where("selected").collect()]
    assert chosen(plottables.soft_power_plot(t)) == [2] and chosen(plottables.soft_power_plot(t, least=0.99)) == [3] and chosen(plottables.soft_power_plot(t, 1)) == [1]
    assert plottables.soft_power_plot(t.limit(0)).count() == 0


@pytest.fixture
def network(spark):
    tom = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.3), ("b", "c", 0.5), ("a", "x", 0.2), ("b", "x", 0.0), ("c", "y", 0.4), ("x", "y", 0.7), ("x", "z", 0.7)], "g1 string, g2 string, tom double")
    modules = spark.createDataFrame([("a", "M1"), ("b", "M1"), ("c", "M1"), ("x", "M2"), ("y", "M2"), ("z", "grey")], "gene string, module string")
    kmes = spark.createDataFrame([("a", "M1", 0.9), ("b", "M1", 0.8), ("c", "M1", 0.1), ("x", "M2", 0.5), ("y", "M2", 0.5)], "gene string, module string, kme double")
    return tom, modules, kmes


def test_hub_network(spark, network):
    tom, modules, kmes = network
    all_of = plottables.hub_network_edges(tom, modules, kmes, 1, 5, 1.0)
    assert rows(all_of, "g1", "g2", "kind", "weight") == [("a", "b", "M1", 1.0), ("a", "c", "M1", 0.0), ("a", "x", "between", 0.5), ("b", "c", "M1", pytest.approx(1 / 3)), ("b", "x", "between", 0.0), ("c", "y", "between", 1.0), ("x", "y", "M2", 1.0)]
    half = plottables.hub_network_edges(tom, modules, kmes, 1, 5, 0.5)
    assert rows(half, "g1", "g2") == [("a", "b"), ("a", "x"), ("b", "c"), ("c", "y"), ("x", "y")]
    assert plottables.hub_network_edges(tom, modules, kmes, 1, 5, 0.5, sample=True).groupBy("kind").count().count() == 3


def test_umap_edges(network):
    tom, modules, _ = network
    hubs = modules.where("gene in ('a', 'x')")
    x = plottables.umap_edges(tom, modules, hubs, 1.0)
    assert rows(x, "g1", "g2", "kind") == [("a", "x", "between"), ("b", "a", "M1"), ("c", "a", "M1"), ("x", "a", "between"), ("y", "x", "M2")]
    assert {r["weight"] for r in x.where("kind = 'between'").collect()} == {0.5}
    assert plottables.umap_edges(tom, modules, hubs, 1.0, keep_between=False).where("kind = 'between'").count() == 0


def test_lollipop_and_heat(spark):
    d = spark.createDataFrame([("A", "B", "M1", 0.5, 0.01), ("A", "B", "M2", -0.5, None), ("A", "B", "M3", None, 0.5), ("A", "C", "M1", 0.0, 0.05)], "g1 string, g2 string, module string, avg_log2fc double, p_val double")
    assert rows(plottables.lollipop(d), "g2", "module", "place", "significant") == [("B", "M1", 2, True), ("B", "M2", 1, False), ("B", "M3", 3, False), ("C", "M1", 1, False)]
    c = spark.createDataFrame([("t", "M1", 0.8, 0.0004), ("t", "M2", -0.4, 0.2), ("u", "M1", 0.1, None)], "trait string, module string, cor double, fdr double")
    assert rows(plottables.trait_heat(c, limit=0.5), "trait", "module", "cor", "label") == [("t", "M1", 0.5, "***"), ("t", "M2", -0.4, ""), ("u", "M1", 0.1, "")]
    assert rows(plottables.trait_heat(c, numeric=True), "trait", "module", "cor", "label") == [("t", "M1", 0.8, "0.000"), ("t", "M2", -0.4, ""), ("u", "M1", 0.1, "")]


def test_overlap_tables(spark):
    o = spark.createDataFrame([("M1", "s", 2.0, 0.01), ("M2", "s", 0.0, 1.0), ("M3", "s", None, 1.0)], "module string, group string, odds_ratio double, fdr double")
    assert rows(plottables.overlap_plot(o, log=False), "module", "value", "limit", "place")[:2] == [("M1", 2.0, 1.0, 2), ("M2", 0.0, 1.0, 1)]
    neg = {r["module"]: r for r in plottables.overlap_plot(o, "fdr", negate=True).collect()}
    assert neg["M1"]["value"] == pytest.approx(-np.log(0.01)) and neg["M1"]["limit"] == pytest.approx(-np.log(0.05)) and neg["M1"]["place"] == 3
    assert {r["module"]: r["value"] for r in plottables.overlap_plot(o).collect()}["M3"] is None
    assert rows(plottables.motif_bars(o, 1), "module", "place") == [("M1", 1), ("M2", 1), ("M3", 1)]


def test_regulator_network(spark):
    regs = spark.createDataFrame([("t", "u", 0.9, 0.4), ("t", "v", -0.5, -0.2), ("u", "t", 0.3, 0.1), ("u", "w", 0.001, 0.1)], "tf string, gene string, cor double, reg_score double")
    x = plottables.tf_network_edges(regs, ["t"], 2)
    assert rows(x, "tf", "gene", "weight", "depth", "degree") == [("t", "u", 0.75, 1, 2), ("t", "v", -0.5, 1, 0), ("u", "t", 0.3, 0, 2)]
    assert rows(plottables.tf_network_edges(regs, ["t"], 2, tfs_only=True), "gene") == [("t",), ("u",)]
    with pytest.raises(ValueError):
        plottables.tf_network_edges(regs, ["t"], 1, weight="size")


def test_regulatory_tables(spark):
    net = spark.createDataFrame([("M1", "M1", 2, 2.0, 1, 0.5), ("M1", "M2", 3, 0.75, 0, 0.0), ("M2", "M1", 0, 0.0, 1, 0.25)], "source string, target string, n_pos int, score_pos double, n_neg int, score_neg double")
    assert rows(plottables.regulatory_edges(net), "source", "target", "score") == [("M1", "M1", 1.0), ("M1", "M2", 0.75)]
    assert rows(plottables.regulatory_edges(net, loops=False, target="M1", least=0.1), "source", "target", "score") == [("M2", "M1", -0.25)]
    assert rows(plottables.regulatory_heat(net, "positive"), "source", "target", "score", "label") == [("M1", "M1", 1.0, ""), ("M1", "M2", 0.75, "3"), ("M2", "M1", 0.0, "")]
    with pytest.raises(ValueError):
        plottables.regulatory_heat(net, "both")


def test_differential_regulon_plot(spark):
    d = spark.createDataFrame([("a", 0.5, -0.5, 0.01, 0.5, 0.2, 0.01), ("b", 0.4, -0.4, 0.9, 0.9, 0.2, 0.5), ("c", -0.3, 0.1, None, 0.05, None, None), ("d", 0.0, 0.1, 0.0, 0.0, 0.0, 0.0)], "tf string, avg_log2fc_positive double, avg_log2fc_negative double, p_val_adj_positive double, p_val_adj_negative double, avg_log2fc_deg double, p_val_adj_deg double")
    x = rows(plottables.differential_regulon_plot(d, n_label=1), "tf", "significant", "is_deg", "quadrant", "labelled")
    assert x == [("a", True, True, "bottom-right", True), ("b", False, False, "bottom-right", False), ("c", True, False, "top-left", True), ("d", False, False, None, False)]
    line = plottables.regulon_line(d).first()
    slope, intercept = np.polyfit([0.5, 0.4, -0.3, 0.0], [-0.5, -0.4, 0.1, 0.1], 1)
    assert line["n"] == 4 and line["slope"] == pytest.approx(slope) and line["intercept"] == pytest.approx(intercept)
    assert plottables.regulon_line(d.limit(0)).first()["slope"] is None


def test_enrichment_of_regulons(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(20)], "gene string")
    regs = spark.createDataFrame([("t", f"g{i}", 0.5) for i in range(6)] + [("t", f"g{i}", -0.5) for i in range(10, 13)] + [("t", "g9", 0.0), ("t", "g0", 0.5), ("t", "elsewhere", 0.5)], "tf string, gene string, cor double")
    sets = spark.createDataFrame([("l", "s", f"g{i}") for i in range(5)] + [("l", "s", "g0"), ("l", "r", "g19")], "library string, term string, gene string")
    [r] = analysis.enrich_regulons(regs, genes, sets).collect()
    assert (r["tf"], r["target_type"], r["term"], r["size_module"], r["size_set"], r["size_intersection"]) == ("t", "positive", "s", 6, 5, 5)
    assert r["pval"] == pytest.approx(6 / 15504) and r["combined_score"] > 0
    assert analysis.enrich_regulons(regs, genes, sets.limit(0)).count() == 0


def test_bars_and_centroids(spark, network):
    _, modules, kmes = network
    assert rows(plottables.topology_bars(modules, kmes, "M1"), "place", "gene", "alpha") == [(1, "a", 1.0), (2, "b", pytest.approx(0.8 / 0.9)), (3, "c", pytest.approx(0.1 / 0.9))]
    k = kmes.select("gene", F.col("kme").alias("k"))
    assert rows(plottables.topology_bars(modules, k, "M2", "k"), "place", "gene") == [(1, "x"), (2, "y")]
    assert rows(plottables.kme_plot(modules, kmes, 2), "module", "place", "gene") == [("M1", 1, "b"), ("M1", 2, "a"), ("M2", 1, "y"), ("M2", 2, "x")]
    coords = spark.createDataFrame([("p", [1.0, 2.0]), ("q", [3.0, 4.0])], "cell string, coords array<double>")
    cells = spark.createDataFrame([("p", 1), ("q", 1)], "cell string, label int")
    assert rows(plottables.centroids(coords, cells, "label"), "group", "x", "y") == [("1", 2.0, 3.0)]
    flags = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("nowhere", True)], "gene string, highly_variable boolean")
    assert rows(features.gene_flagged(modules.select("gene"), flags), "gene") == [("a",)]
