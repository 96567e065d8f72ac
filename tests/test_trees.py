import numpy as np
import pytest
from pyspark.sql import functions as F

from coexnet.operators import clustering, features, modules, network, plottables


def plain_ward(x):
    """Merges (left, right, height) one pair at a time, from centres; equal heights by first leaves."""
    groups = {i: [i] for i in range(len(x))}
    out = []
    while len(groups) > 1:
        best = None
        for i, a in groups.items():
            for j, b in groups.items():
                if min(a) < min(b):
                    h = np.sqrt(round(2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), 12))
                    key = (round(h, 9), min(a), min(b))
                    best = min(best or (key, h, i, j), (key, h, i, j))
        _, h, i, j = best
        i, j = min(i, j), max(i, j)
        out.append((i, j, h))
        groups[len(x) + len(out) - 1] = groups.pop(i) + groups.pop(j)
    return out, next(iter(groups.values()))


def long(spark, x):
    return spark.createDataFrame([(f"r{i:02d}", f"c{j}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]], "gene string, cell string, value double")


@pytest.mark.parametrize("kind", ["random", "sparse with equal rows"])
def test_ward_equals_plain_centres(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4)) if kind == "random" else np.repeat(rng.integers(0, 3, (5, 6)).astype(float), 3, 0) + np.eye(1, 6)
    d = clustering.row_distances(long(spark, x))
    got = {(r["g1"], r["g2"]): r["square"] for r in d.collect()}
    assert len(got) == len(x) * (len(x) - 1) // 2
    assert all(np.isclose(got[f"r{i:02d}", f"r{j:02d}"], ((x[i] - x[j]) ** 2).sum(), atol=1e-9) for i in range(len(x)) for j in range(i + 1, len(x)))
    merges, leaves = plain_ward(x)
    rows = clustering.linkage(d, "square", "ward").orderBy("step").collect()
    assert [(r["left"], r["right"]) for r in rows] == [m[:2] for m in merges]
    assert np.allclose([r["height"] for r in rows], [m[2] for m in merges], atol=1e-6)
    places = {r["gene"]: r["place"] for r in clustering.leaf_order(d, "square", "ward").collect()}
    assert sorted(places, key=places.get) == [f"r{i:02d}" for i in leaves]


def test_ward_needs_every_pair(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "g1 string, g2 string, square double")
    with pytest.raises(ValueError):
        clustering.linkage(d, "square", "ward")
    with pytest.raises(ValueError):
        clustering.linkage(d, "square", "median")
    assert clustering.linkage(d.limit(0), "square", "ward").count() == 0


def test_order_of_heat_map(spark):
    score = {("M1", "M1"): 0.9, ("M2", "M1"): 0.1, ("M3", "M1"): 0.8, ("M10", "M1"): 0.0}
    heat = spark.createDataFrame([(s, t, score.get((t, s), 0.0)) for s in ("M1", "M2", "M3", "M10") for t in ("M1", "M2", "M3", "M10")], "source string, target string, score double")
    place = {r["gene"]: r["place"] for r in plottables.regulatory_heat_order(heat).collect()}
    assert sorted(place.values()) == [0, 1, 2, 3] and abs(place["M1"] - place["M3"]) == 1 and abs(place["M2"] - place["M10"]) == 1
    two = heat.where("source in ('M2', 'M10') and target in ('M2', 'M10')")
    assert {(r["gene"], r["place"]) for r in plottables.regulatory_heat_order(two).collect()} == {("M2", 0), ("M10", 1)}


def test_correlogram(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(2, 40))
    x = np.array([base[0], base[1], base[0] + 0.1 * rng.normal(size=40), base[1] + 0.1 * rng.normal(size=40)])
    names = ["M1", "M2", "M10", "grey"]
    mes = spark.createDataFrame([(c, names[i], float(x[i, c])) for i in range(4) for c in range(40)], "cell long, module string, me double")
    rows = {(r["m1"], r["m2"]): r for r in plottables.correlogram(mes, "hclust", exclude_grey=False).collect()}
    assert len(rows) == 6
    r = rows["M1", "M2"]
    want = np.corrcoef(x[0], x[1])[0, 1]
    assert np.isclose(r["cor"], want) and abs(rows["M1", "M10"]["place1"] - rows["M1", "M10"]["place2"]) == 1
    t = np.linspace(0, abs(want) * np.sqrt(38 / (1 - want**2)), 20001)
    density = (1 + t**2 / 38) ** -19.5
    full = np.linspace(-400, 400, 2000001)
    inside = 2 * np.trapezoid(density, t) / np.trapezoid((1 + full**2 / 38) ** -19.5, full)
    assert np.isclose(r["p"], 1 - inside, atol=1e-6) and rows["M1", "M10"]["p"] < 1e-12
    kept = plottables.correlogram(mes, "alphabet").collect()
    assert {(r["m1"], r["place1"], r["m2"], r["place2"]) for r in kept} == {("M1", 0, "M10", 1), ("M1", 0, "M2", 2), ("M10", 1, "M2", 2)}
    assert {(r["m1"], r["m2"], r["place1"], r["place2"]) for r in plottables.correlogram(mes).collect()} == {("M1", "M2", 0, 1), ("M1", "M10", 0, 2), ("M10", "M2", 2, 1)}
    assert plottables.correlogram(mes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        plottables.correlogram(mes, "size")


def test_scores_anew_after_merging(spark):
    """A chain of modules: after the first merge its score comes near enough to the third's."""
    given = spark.createDataFrame([("a", "M1"), ("b", "M2"), ("c", "M3"), ("d", "M4"), ("e", "grey")], "gene string, module string")
    asked = []

    def scores_of(m):
        asked.append(sorted(r["module"] for r in m.select("module").distinct().collect()))
        return m.select("module").distinct()

    def cor_of(scores):
        names = sorted(r["module"] for r in scores.collect() if r["module"] != "grey")
        near = {("M1", "M2"): 0.95, ("M1", "M3"): 0.5 if "M2" in names else 0.9}
        return spark.createDataFrame([(a, b, near.get((a, b), 0.0)) for i, a in enumerate(names) for b in names[i + 1 :]], "m1 string, m2 string, cor double")

    merge = lambda n: {r["gene"]: r["module"] for r in clustering.merge_modules(given, scores_of, cor_of, 0.2, n)[0].collect()}
    assert merge(1) == {"a": "M1", "b": "M1", "c": "M3", "d": "M4", "e": "grey"}
    assert asked == [["M1", "M2", "M3", "M4", "grey"], ["M1", "M3", "M4", "grey"]]
    assert merge(9) == {"a": "M1", "b": "M1", "c": "M1", "d": "M4", "e": "grey"}


def test_first_flagged_genes(spark):
    expr = spark.createDataFrame([(1, g, 1.0) for g in "abcd"], "cell long, gene string, value double")
    flags = spark.createDataFrame([("a", True, 3), ("b", True, 1), ("c", None, 0), ("d", True, None), ("x", True, 0)], "gene string, highly_variable boolean, place int")
    first = lambda n, place=None: {r["gene"] for r in features.gene_flagged(expr, flags, n_genes=n, place=place).collect()}
    assert first(1, "place") == {"b"} and first(2, "place") == {"a", "b"} and first(9, "place") == {"a", "b", "d"}
    assert first(2) == {"a", "b"}


def test_fit_without_first_bin(spark):
    rng = np.random.default_rng(0)
    k = rng.pareto(2.0, 200) + 1
    table = spark.createDataFrame([(6, f"g{i}", float(v)) for i, v in enumerate(k)], "power int, gene string, k double")
    bins = sorted((r["bin"], r["dk"], r["p_dk"]) for r in network.scale_free_bins(table).collect())[1:]
    x, y = np.log10([b[1] for b in bins]), np.log10(np.array([b[2] for b in bins]) + 1e-9)
    got = network.scale_free_fit(table, remove_first=True).first()
    assert np.isclose(got["slope"], np.polyfit(x, y, 1)[0]) and np.isclose(got["sft_r_sq"], np.corrcoef(x, y)[0, 1] ** 2)
    assert network.scale_free_fit(table, n_breaks=3, remove_first=True).first()["sft_r_sq"] == 0


def test_module_order_of_names(spark):
    names = spark.createDataFrame([("M2",), ("M10",), ("M1",)], "module string")
    assert [r["module"] for r in names.orderBy(modules.module_order(F.col("module"))).collect()] == ["M1", "M2", "M10"]
