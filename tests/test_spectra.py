import numpy as np
import pytest

from coexnet.operators import spectra


def tables(spark, x, zero, names):
    rows = [(int(i), f"g{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    zeros = [(f"g{j:03d}", float(zero[j])) for j in range(len(zero))]
    return spark.createDataFrame(rows, "cell int, gene string, value double"), spark.createDataFrame(zeros, "gene string, zero double"), spark.createDataFrame([(f"g{j:03d}", m) for j, m in enumerate(names)], "gene string, module string")


@pytest.mark.parametrize("components", [1, 4])
def test_leading_vectors_equal_singular_vectors(spark, components):
    """Modules of 1 to 120 genes, with and without a strong direction; most values absent, some cells without any."""
    rng = np.random.default_rng(components)
    names = ["one"] + ["two"] * 2 + ["noise"] * 45 + ["strong"] * 120
    x = rng.normal(size=(70, len(names))) * (rng.random((70, len(names))) < 0.4)
    x[:, 48:] += np.outer(rng.normal(size=70), rng.normal(size=120)) * (rng.random((70, 120)) < 0.5)
    x[60:] = 0
    zero = rng.normal(size=len(names)) * 0.3
    got = {}
    for r in spectra.leading(*tables(spark, x, zero, names), 70, components).collect():
        got.setdefault(r["module"], {}).setdefault(r["component"], {})[r["gene"]] = r["loading"]
    assert set(got) == set(names)
    for m in got:
        own = [j for j, k in enumerate(names) if k == m]
        v = np.linalg.svd((x + zero)[:, own], full_matrices=False)[2][:components]
        assert len(got[m]) == min(components, len(own))
        for k, load in got[m].items():
            mine = np.array([load[f"g{j:03d}"] for j in own])
            assert mine[np.abs(mine).argmax()] > 0 and np.isclose(abs(mine @ v[k]), 1, atol=1e-9)


def test_a_large_module_needs_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.outer(rng.normal(size=40), rng.normal(size=900)) + 0.3 * rng.normal(size=(40, 900))
    monkeypatch.setattr(spectra, "MOST_PASSES", 12)
    rows = spectra.leading(*tables(spark, x, np.zeros(900), ["m"] * 900), 40).orderBy("gene").collect()
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    assert np.isclose(abs(np.array([r["loading"] for r in rows]) @ v), 1, atol=1e-9)


def test_edges(spark):
    empty = tables(spark, np.zeros((3, 0)), [], [])
    assert spectra.leading(*empty, 3).count() == 0
    rows = spectra.leading(*tables(spark, np.zeros((3, 2)), [0.0, 0.0], ["m", "m"]), 3).collect()  # nothing but zeros
    assert len(rows) == 2 and np.isclose(sum(r["loading"] ** 2 for r in rows), 1)


def test_embedding_is_the_principal_plane(spark):
    rng = np.random.default_rng(9)
    x = rng.random((30, 6))
    df = spark.createDataFrame([(f"g{i:02d}", f"h{j}", float(x[i, j])) for i in range(30) for j in range(6)], "gene string, hub string, tom double")
    got = np.array([(r["c0"], r["c1"]) for r in spectra.embed(df).orderBy("gene").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    for k in range(2):
        assert np.allclose(np.abs(got[:, k]), np.abs(u[:, k] * s[k]), atol=1e-7)
