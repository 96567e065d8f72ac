import hashlib
import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from coexnet.functions import stats
from coexnet.operators import analysis, clustering, correlation, features, metacells, modules, network, plotdata, projection, regulation


def long(spark, x, genes=None, cells=None):
    """Sparse table of a genes x cells array."""
    rows = [(f"c{j:03d}", (genes or [f"g{i:03d}" for i in range(len(x))])[i], float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]
    return spark.createDataFrame(rows, "cell string, gene string, value double")


def square(pairs, n, value="cor"):
    m = np.eye(n)
    for r in pairs.collect():
        i, j = int(r["g1"][1:]), int(r["g2"][1:])
        m[i, j] = m[j, i] = r[value]
    return m


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.8, (8, 40)).astype(float)
    x[3] = 0
    x[3, 5] = 2
    x[6] = 3  # constant
    return x


def ranks(v):
    order = np.argsort(v, kind="stable")
    r = np.empty(len(v))
    for value in np.unique(v):
        at = np.flatnonzero(v[order] == value)
        r[order[at]] = at.mean() + 1
    return r


def test_correlations(spark, counts):
    expr, n = long(spark, counts), counts.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.nan_to_num(np.corrcoef(counts))
        want_s = np.nan_to_num(np.corrcoef([ranks(v) for v in counts]))
    np.fill_diagonal(want, 1)
    np.fill_diagonal(want_s, 1)
    for plan in ("relational", "blocked"):
        assert np.allclose(square(correlation.pearson(expr, n, plan, 7), 8), want)
        assert np.allclose(square(correlation.spearman(expr, n, plan), 8), want_s)
    med = np.median(counts, 1, keepdims=True)
    mad = np.median(abs(counts - med), 1, keepdims=True)
    u = (counts - med) / (9 * np.where(mad < 1e-15, 1, mad))
    z = np.where(abs(u) < 1, (counts - med) * (1 - u**2) ** 2, 0)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-15)
    want_b = z @ z.T
    np.fill_diagonal(want_b, 1)
    for plan in ("relational", "blocked"):
        assert np.allclose(square(correlation.bicor(expr, n, plan), 8), want_b, atol=1e-9)
    negative = counts - 1
    assert np.allclose(square(correlation.spearman(long(spark, negative), n), 8), want_s)


def test_network(spark):
    rng = np.random.default_rng(1)
    c = np.corrcoef(rng.normal(size=(9, 20)))
    rows = [(f"g{i}", f"g{j}", float(c[i, j])) for i in range(9) for j in range(i + 1, 9)]
    pairs = spark.createDataFrame(rows, "g1 string, g2 string, cor double")
    a = ((1 + c) / 2) ** 6
    np.fill_diagonal(a, 0)
    adj = network.adjacency(pairs, 6)
    k = a.sum(0)
    assert np.allclose([r["k"] for r in network.degrees(adj).orderBy("gene").collect()], k)
    for pick, f in (("min", np.minimum), ("max", np.maximum)):
        want = (a @ a + a) / (f.outer(k, k) + 1 - a)
        np.fill_diagonal(want, 1)
        for plan in ("relational", "blocked"):
            assert np.allclose(square(network.topological_overlap(adj, pick, plan), 9, "tom"), want)
    assert np.allclose(square(network.adjacency(pairs, 2, "unsigned"), 9, "adj"), c**2 * (1 - np.eye(9)) + np.eye(9))
    with pytest.raises(ValueError):
        network.adjacency(pairs, 2, "other")
    table = {r["power"]: r for r in network.power_table(pairs, (1, 6)).collect()}
    assert math.isclose(table[6]["mean_k"], k.mean()) and math.isclose(table[6]["max_k"], k.max()) and math.isclose(table[6]["median_k"], np.median(k))
    lo, hi = k.min(), k.max()
    place = np.clip(np.ceil(np.round((k - lo) / ((hi - lo) / 10), 9)) - 1, 0, 9).astype(int)
    dk = np.array([k[place == b].mean() if (place == b).any() else lo + (hi - lo) * (b + 0.5) / 10 for b in range(10)])
    x, y = np.log10(dk), np.log10(np.bincount(place, minlength=10) / 9 + 1e-9)
    slope, cut = np.polyfit(x, y, 1)
    assert math.isclose(table[6]["slope"], slope, rel_tol=1e-6) and math.isclose(table[6]["sft_r_sq"], max(0, 1 - ((y - slope * x - cut) ** 2).sum() / ((y - y.mean()) ** 2).sum()), rel_tol=1e-6)
    b = np.linalg.lstsq(np.stack([np.ones(10), x, dk], 1), y, rcond=None)[0]
    r2 = 1 - ((y - np.stack([np.ones(10), x, dk], 1) @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(table[6]["truncated_r_sq"], max(0, 1 - (1 - r2) * 9 / 7), rel_tol=1e-5, abs_tol=1e-9)


def planted():
    rng = np.random.default_rng(7)
    factors = rng.normal(size=(4, 120))
    x = np.concatenate([0.9 * f + 0.5 * rng.normal(size=(30, 120)) for f in factors] + [rng.normal(size=(30, 120))])
    return x, np.repeat([1, 2, 3, 4, 0], 30)


@pytest.mark.parametrize("method", ["static", "gap"])
def test_planted_modules(spark, method):
    x, truth = planted()
    expr = long(spark, x)
    tom = network.topological_overlap(network.adjacency(correlation.pearson(expr, 120, "blocked"), 6), "min", "blocked")
    found = clustering.detect_modules(tom, method, 0.8, min_size=20)
    named = spark.createDataFrame([(f"g{i:03d}", f"M{t}" if t else "grey") for i, t in enumerate(truth)], "gene string, module string")
    assert plotdata.agreement(found, named).first()["ari"] > 0.9


def test_linkage_against_plain_loops():
    rng = np.random.default_rng(2)
    d = rng.random((25, 25))
    d = d + d.T
    clusters, heights = [[i] for i in range(25)], []
    while len(clusters) > 1:
        h, i, j = min((np.mean([d[p, q] for p in clusters[i] for q in clusters[j]]), i, j) for i in range(len(clusters)) for j in range(i))
        clusters[j] = clusters[j] + clusters.pop(i)
        heights.append(h)
    z = clustering.average_linkage(d)
    assert np.allclose(z[:, 2], heights) and z[-1, 3] == 25
    assert len(set(clustering.cut_static(z, 25, heights[15] + 1e-9, 1))) == 25 - 16


def test_linkage_in_rounds_is_the_same_tree(spark):
    rng = np.random.default_rng(11)
    d = rng.random((22, 22))
    d = (d + d.T) / 2
    rows = [(f"g{i:02d}", f"g{j:02d}", float(1 - d[i, j])) for i in range(22) for j in range(i + 1, 22)]
    tom = spark.createDataFrame(rows, "g1 string, g2 string, tom double").repartition(3)
    genes, z = clustering.tree(tom)
    want = clustering.average_linkage(d)
    assert genes == sorted(genes) and np.allclose(z, want)
    assert clustering.linkage(tom).count() == 21
    apart = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.8)], "g1 string, g2 string, tom double")
    assert clustering.tree(apart)[1][:, 2].round(6).tolist() == [0.1, 0.2, 1.0]
    assert clustering.detect_modules(tom.limit(0)).count() == 0 and clustering.linkage(tom.limit(0)).count() == 0


def test_absent_zeros_are_zeros(spark):
    """Scores of sparse and dense input agree, also for cells and genes that are mostly zero."""
    rng = np.random.default_rng(4)
    x = rng.poisson(0.5, (9, 70)).astype(float)
    x[:, 60:] = 0  # cells without a count
    cells = spark.createDataFrame([(f"c{j:03d}",) for j in range(70)], "cell string")
    dense = spark.createDataFrame([(f"c{j:03d}", f"g{i}", float(x[i, j])) for i in range(9) for j in range(70)], "cell string, gene string, value double")
    sparse = dense.where("value <> 0")
    mods = spark.createDataFrame([(f"g{i}", f"M{1 + i % 2}") for i in range(9)], "gene string, module string")
    table = lambda df, v: np.array([[r[v] for r in df.where(f"module = 'M{m}'").orderBy("cell").collect()] for m in (1, 2)])
    a, b = table(modules.eigengenes(dense, mods, 70, cells=cells), "me"), table(modules.eigengenes(sparse, mods, 70, cells=cells), "me")
    assert a.shape == b.shape == (2, 70) and np.allclose(a, b, atol=1e-8)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    u, s, _ = np.linalg.svd(np.clip(z[::2], -10, 10).T, full_matrices=False)
    assert np.allclose(np.abs(u[:, 0] * s[0]), np.abs(a[0]), atol=1e-6)
    p, q = (table(projection.project_modules(dense, t, mods, 70, 70, least_shared=5, cells=cells), "score") for t in (dense, sparse))
    assert np.allclose(p, q, atol=1e-8)
    few = mods.where("gene in ('g0', 'g2', 'g1')")
    assert projection.project_modules(dense, sparse, few, 70, 70, least_shared=3, least_genes=2, cells=cells).select("module").distinct().count() == 1
    nan = spark.createDataFrame([("a", "g", float("nan")), ("b", "g", 3.0)], "cell string, gene string, value double")
    assert {r["cell"]: r["value"] for r in correlation.impute_means(nan, 4).collect()} == {"a": 1.0, "b": 3.0}


def test_bicor_connectivity(spark):
    x, _ = planted()
    me = x[:10].mean(0)
    cells = [f"c{j:03d}" for j in range(120)]
    mes = spark.createDataFrame([(c, "M1", float(v)) for c, v in zip(cells, me, strict=True)], "cell string, module string, me double")

    def weights(v):
        c = v - np.median(v)
        u = c / (9 * np.median(np.abs(c)))
        z = np.where(np.abs(u) < 1, c * (1 - u * u) ** 2, 0)
        return z / np.linalg.norm(z)

    got = {r["gene"]: r["kme"] for r in modules.kme_bicor(long(spark, x[:12]), mes, 120).collect()}
    want = [weights(v) @ weights(me) for v in x[:12]]
    assert np.allclose([got[k] for k in sorted(got)], want)


def test_module_score_leaves_out_its_own_genes(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(3, (40, 30)).astype(float)
    expr = long(spark, x)
    every = expr.select("gene").distinct().withColumn("module", F.lit("M1"))
    assert analysis.module_score(expr, every, 30).count() == 0  # nothing is left to compare with
    some = every.where("gene < 'g020'")
    control = {r["cell"]: r["score"] for r in analysis.module_score(expr, some, 30, n_bins=1).collect()}
    assert np.allclose([control[k] for k in sorted(control)], x[:20].mean(0) - x[20:].mean(0))


def test_preservation_levels(spark):
    x, truth = planted()
    mods = spark.createDataFrame([(f"g{i:03d}", f"M{t}" if t else "grey") for i, t in enumerate(truth)], "gene string, module string")
    expr = long(spark, x)
    tom = network.topological_overlap(network.adjacency(correlation.pearson(expr, 120, "blocked"), 6), "min", "blocked")
    r = {p["module"]: p for p in projection.preservation(tom, mods, 20).collect()}
    t = square(tom, 150, "tom")
    np.fill_diagonal(t, 1)
    assert all(r[f"M{m}"]["preservation"] == "highly preserved" and math.isclose(r[f"M{m}"]["median_rank"], np.median(np.median(t[np.ix_(truth == m, truth == m)], 1))) for m in (1, 2, 3, 4))
    with pytest.raises(ValueError, match="common genes"):
        projection.preservation(tom, mods.limit(20))


def test_large_groups_of_cells_are_dealt_into_blocks(spark):
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(90, 3)).round(2)
    coords = spark.createDataFrame([("a" if i < 80 else None if i > 86 else "b", i, pts[i].tolist()) for i in range(90)], "group string, cell long, coords array<double>").where("group is not null")
    got = {}
    for r in metacells.knn_within_group(coords, 4, block_cells=15).collect():
        got.setdefault(r["cell"], []).append((r["rank"], r["neighbour"]))
    for i in range(87):
        lo, hi = (0, 80) if i < 80 else (80, 87)
        d = np.round(((pts[lo:hi] - pts[i]) ** 2).sum(1), 9)
        want = [j + lo for j in np.lexsort((np.arange(hi - lo), d)) if j + lo != i][:4]
        assert [n for _, n in sorted(got[i])] == want


def test_eigengenes_and_kme(spark):
    x, truth = planted()
    expr = long(spark, x)
    mods = spark.createDataFrame([(f"g{i:03d}", f"M{t}" if t else "grey") for i, t in enumerate(truth)], "gene string, module string")
    me = modules.eigengenes(expr, mods, 120)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    for m in (1, 2):
        got = np.array([r["me"] for r in me.where(F.col("module") == f"M{m}").orderBy("cell").collect()])
        u, s, _ = np.linalg.svd(z[truth == m].T, full_matrices=False)
        want = u[:, 0] * s[0]
        want *= np.sign(np.corrcoef(want, x[truth == m].mean(0))[0, 1])
        assert np.allclose(got, want, atol=1e-6)
    k = {(r["gene"], r["module"]): r["kme"] for r in modules.kme(expr, me, 120).collect()}
    got = np.array([r["me"] for r in me.where("module = 'M1'").orderBy("cell").collect()])
    assert math.isclose(k["g045", "M1"], np.corrcoef(x[45], got)[0, 1], abs_tol=1e-9) and len(k) == 150 * 4
    merged = clustering.merge_close(mods, modules.module_correlation(me), 0.2)
    assert plotdata.agreement(merged, mods).first()["ari"] == 1
    with pytest.raises(ValueError):
        modules.reassign_manual(mods, {"g000": "M2"})
    assert modules.reassign_manual(mods, {"g149": "M2"}).where("gene = 'g149'").first()["module"] == "M2"
    names = spark.createDataFrame([("a", "M10"), ("b", "M2"), ("c", "grey")], "gene string, module string")
    assert {r["gene"]: r["new_module"] for r in modules.rename_modules(names, "N").collect()} == {"a": "N2", "b": "N1", "c": "grey"}


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None)], "k string, p double")
    got = {r["k"]: r["fdr"] for r in stats.bh(p, "p", []).collect()}
    assert np.allclose([got[k] for k in "abcde"], [0.025, 0.05, 0.05, 0.025, 1.0])
    assert math.isclose(stats.t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(stats.mwu_exact_p(0, 3, 3), 0.1) and math.isclose(stats.mwu_exact_p(4.0, 2, 4), 1.0)
    f = spark.createDataFrame([(3, 5, 4, 20)], "a int, m int, k int, n int").select(stats.fisher_greater("a", "m", "k", "n")).first()[0]
    assert math.isclose(f, (10 * 15 + 5) / 4845, rel_tol=1e-9)
    rows = [(float(v), True) for v in (1, 2, 2, 5)] + [(float(v), False) for v in (2, 3, 6, 7, 8)]
    r = stats.rank_sum(spark.createDataFrame([("x", *x) for x in rows], "k string, v double, f boolean"), ["k"], "v", F.col("f")).first()
    assert (r["n1"], r["n2"], r["u1"]) == (4, 5, 3.0)
    a, b = np.array([1, 2, 2, 5.0]), np.array([2, 3, 6, 7, 8.0])
    w = stats.welch(spark.createDataFrame([("x", *x) for x in rows], "k string, v double, f boolean"), ["k"], "v", F.col("f")).first()
    assert math.isclose(w["t"], (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 4 + b.var(ddof=1) / 5))


def test_features(spark, counts):
    expr = long(spark, counts)
    assert {r["gene"] for r in features.gene_fraction(expr, 40, 0.05).collect()} == {f"g{i:03d}" for i in range(8) if i != 3}
    got = [r["gene"] for r in features.gene_cv2(expr, 40, 3).collect()]
    cv2 = counts.var(1) / (counts.mean(1) ** 2 + 1e-8)
    assert got == [f"g{i:03d}" for i in np.argsort(-cv2)[:3]]
    assert "g006" not in {r["gene"] for r in features.good_genes(expr, 40).collect()}
    assert [r["gene"] for r in features.gene_custom(expr, ["g002", "nope", "g000"]).orderBy("ord").collect()] == ["g002", "g000"]
    cells = expr.select("cell").distinct().withColumn("g", F.substring("cell", 4, 1).cast("int") % 2)
    bulk = {(r["g"], r["gene"]): r["value"] for r in features.pseudobulk(expr, cells, ["g"]).collect()}
    assert math.isclose(bulk[0, "g000"], counts[0, ::2].mean())
    with pytest.raises(ValueError):
        features.pseudobulk(expr, cells, ["g"], "median")
    with pytest.raises(ValueError):
        features.gene_custom(expr, [])
    z = {(r["cell"], r["gene"]): r["value"] for r in features.log_normalize(expr).collect()}
    assert math.isclose(z["c005", "g003"], math.log1p(2 / counts[:, 5].sum() * 1e4))


def test_metacells(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(60, 2))
    rows = [("a" if i < 50 else "b", f"c{i}", pts[i].tolist()) for i in range(60)]
    coords = spark.createDataFrame(rows, "group string, cell string, coords array<double>")
    knn = metacells.knn_within_group(coords, 3).where("cell = 'c7'").orderBy("rank").collect()
    d = ((pts[:50] - pts[7]) ** 2).sum(1)
    assert [r["neighbour"] for r in knn] == [f"c{i}" for i in np.argsort(d)[1:4]]
    m = metacells.metacell_members(coords, 12, 4).collect()
    sets = {}
    for r in m:
        sets.setdefault(r["metacell"], set()).add(r["cell"])
    a = [s for k, s in sets.items() if k.startswith("a")]
    assert len(a) > 1 and all(len(s) == 12 for s in a) and all(len(s & t) <= 4 for s in a for t in a if s is not t)
    assert sets["b_1"] == {f"c{i}" for i in range(50, 60)}


@pytest.mark.parametrize("k,most,target", [(12, 3, None), (8, 2, 1000), (8, 5, 4), (5, 0, 1000)])
def test_metacells_equal_the_sequential_choice(spark, k, most, target):
    rng = np.random.default_rng(k)
    pts = np.concatenate([rng.normal(size=(70, 2)), 5 + 0.01 * rng.normal(size=(20, 2)), rng.normal(size=(6, 2))])
    rows = [("a" if i < 90 else "b", i, pts[i].tolist()) for i in range(96)]
    coords = spark.createDataFrame(rows, "group string, cell long, coords array<double>")
    hoods = {i: {i} for i in range(90)}
    for r in metacells.knn_within_group(coords.where("group = 'a'"), k - 1, block_cells=40).collect():
        hoods[r["cell"]].add(r["neighbour"])
    order, taken = sorted(range(90), key=lambda i: (hashlib.md5(f"{i}#0".encode()).hexdigest(), i))[:60], []
    for c in order:
        if len(taken) < (target or 90 // k) and all(len(hoods[c] & t) <= most for t in taken):
            taken.append(hoods[c])
    got = {}
    for r in metacells.metacell_members(coords, k, most, target, max_iter=60).collect():
        got.setdefault(r["metacell"], set()).add(r["cell"])
    small = {m: s for m, s in got.items() if m.startswith("b")}
    assert {m: s for m, s in got.items() if m not in small} == {f"a_{i}": t for i, t in enumerate(taken, 1)}
    assert small == ({"b_1": set(range(90, 96))} if k >= 6 else small)


def test_overlap_projection_regulation(spark):
    mods = spark.createDataFrame([(f"g{i}", "M1" if i < 5 else "M2" if i < 12 else "grey") for i in range(20)], "gene string, module string")
    sets = spark.createDataFrame([(f"g{i}", "s") for i in (0, 1, 2, 19)] + [("absent", "s")], "gene string, group string")
    r = {x["module"]: x for x in analysis.overlap_test(analysis.overlap_counts(mods, sets), 20).collect()}
    assert r["M1"]["size_intersection"] == 3 and math.isclose(r["M1"]["jaccard"], 0.5) and math.isclose(r["M1"]["pval"], 155 / 4845) and r["M2"]["size_intersection"] == 0
    few = spark.createDataFrame([("c", "G0", 1.0)], "cell string, gene string, value double")
    with pytest.raises(ValueError, match="shared genes"):
        projection.project_modules(few, few, mods, 1, 1)
    e = spark.createDataFrame([("t1", "a", 0.5, 0.3), ("t2", "a", 0.4, -0.3), ("t1", "t2", 0.2, 0.9), ("t2", "b", 0.001, 0.1)], "tf string, gene string, gain double, cor double")
    a = regulation.regulons(e, "A", n_tfs=1)
    assert {(x["tf"], x["gene"]) for x in a.collect()} == {("t1", "a"), ("t1", "t2")}
    assert regulation.regulons(e, "C").count() == 3
    deep = regulation.targets_by_depth(regulation.regulons(e, "C"), ["t1"], 2)
    assert sorted((x["depth"], x["tf"], x["gene"]) for x in deep.collect()) == [(1, "t1", "a"), (1, "t1", "t2"), (2, "t1", "a"), (2, "t1", "t2"), (2, "t2", "a")]
    with pytest.raises(ValueError):
        regulation.targets_by_depth(a, ["nobody"])


def test_tail_of_student_keeps_its_figures_at_many_degrees_of_freedom():
    with localcontext(prec=40):
        for dof, t in ((66, 1.2), (20_000, 2.4), (200_000, 1.7), (600_000, 1.2), (600_000, 1.7), (600_000, 4.0)):
            y, term = Decimal(dof) / (dof + Decimal(t) ** 2), Decimal(1)
            total = term
            for k in range(1, dof // 2):  # the finite sum for even degrees of freedom
                term *= y * (2 * k - 1) / (2 * k)
                total += term
            exact = 1 - Decimal(t) / (dof + Decimal(t) ** 2).sqrt() * total
            assert math.isclose(stats.t_two_sided(t, dof), float(exact), rel_tol=1e-10)
