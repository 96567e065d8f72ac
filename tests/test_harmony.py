import numpy as np
from pyspark.sql import functions as F

from coexnet.operators import harmony, modules


def planted(rng):
    """Two groups of cells in three components; the second batch is moved."""
    group, batch = rng.integers(0, 2, 120), rng.integers(0, 2, 120)
    z = np.where(group[:, None] == 0, [4.0, 0, 1], [0, 4.0, 1]) + rng.normal(0, 0.3, (120, 3))
    return group, batch, z + np.where(batch[:, None] == 1, [1.0, 1.0, -0.5], 0)


def plain(ids, z, batch, rounds, inner, k, seed="0"):
    """The same passes on arrays."""
    import hashlib

    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}#{ids[i]}".encode()).hexdigest(), str(ids[i])))
    y, seen, zc = harmony.unit(z[order[:k]]), None, z.copy()
    hot = np.eye(batch.max() + 1)[batch]
    for _ in range(rounds):
        for _ in range(inner):
            r = harmony.memberships(zc, batch, y, seen)
            y = harmony.unit(r.T @ harmony.unit(zc))
            seen = r.T @ hot if seen is None else seen + harmony.STEP * (r.T @ hot - seen)
        r = harmony.memberships(zc, batch, y, seen)
        zc = z.copy()
        for c in range(k):
            phi = np.hstack([np.ones((len(z), 1)), hot])
            w = np.linalg.solve((phi * r[:, [c]]).T @ phi + np.diag([0.0] + [1.0] * hot.shape[1]), (phi * r[:, [c]]).T @ z)
            w[0] = 0
            zc -= r[:, [c]] * (phi @ w)
    return zc


def test_harmony(spark):
    rng = np.random.default_rng(5)
    group, batch, z = planted(rng)
    scores = spark.createDataFrame([(i, m, (z[i] * s).tolist()) for i in range(120) for m, s in (("M1", 1.0), ("M2", 2.0))], "cell long, module string, z array<double>")
    cells = spark.createDataFrame([(i, f"b{batch[i]}") for i in range(120)], "cell long, batch string")
    got = harmony.harmony(scores, cells, ["batch"], rounds=2, inner=3, tolerance=0.0)
    for m, s in (("M1", 1.0), ("M2", 2.0)):
        have = np.array([r["z"] for r in got.where(F.col("module") == m).orderBy("cell").collect()])
        assert np.allclose(have, plain(list(range(120)), z * s, batch, 2, 3, 12), atol=1e-7)
        apart = lambda x: np.mean([np.linalg.norm(x[(group == g) & (batch == 0)].mean(0) - x[(group == g) & (batch == 1)].mean(0)) for g in (0, 1)])
        assert apart(have) < 0.5 * apart(z * s)
        assert apart(plain(list(range(120)), z * s, batch, 5, 5, 12)) < 0.2 * apart(z * s)
        assert np.linalg.norm(have[group == 0].mean(0) - have[group == 1].mean(0)) > 4 * s  # groups stay apart
    one = harmony.harmony(scores, cells.withColumn("batch", F.lit("x")), ["batch"])
    assert one.count() == 240 and one.where("cell = 3 and module = 'M1'").first()["z"] == z[3].tolist()


def test_component_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (5, 40))
    expr = spark.createDataFrame([(j, f"g{i}", float(x[i, j])) for i in range(5) for j in range(40)], "cell long, gene string, value double")
    named = spark.createDataFrame([(f"g{i}", "M1") for i in range(5)], "gene string, module string")
    z = np.array([r["z"] for r in modules.component_scores(expr, named, 40, 3).orderBy("cell").collect()])
    first = np.array([r["me"] for r in modules.eigengenes(expr, named, 40).orderBy("cell").collect()])
    s = np.linalg.svd((x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))[1]
    assert np.allclose(z[:, 0], first) and np.allclose(np.linalg.norm(z, axis=0), s[:3])


def test_parallel_start(spark):
    """Twelve groups of cells, most of them small: the oversampled start finds each, a start by hash misses some."""
    rng = np.random.default_rng(7)
    sizes = [400, 300] + [6] * 10
    axes = harmony.unit(rng.normal(size=(12, 8)))
    z = np.vstack([axes[i] * 5 + rng.normal(0, 0.15, (s, 8)) for i, s in enumerate(sizes)])
    table = spark.createDataFrame([(i, "M1", x.tolist(), x.tolist(), i % 2) for i, x in enumerate(z)], "cell long, module string, z array<double>, zc array<double>, b int").repartition(5)
    found = harmony.parallel_start(table, 12)
    assert found["M1"].shape == (12, 8) and np.allclose(np.linalg.norm(found["M1"], axis=1), 1)
    assert (found["M1"] @ axes.T).max(0).min() > 0.99
    by_hash = harmony.hash_start(table, 12, len(z))
    good, poor = harmony.cost(table, found)["M1"], harmony.cost(table, by_hash)["M1"]
    best = sum(2 - 2 * (harmony.unit(z[a:b]) @ harmony.unit(harmony.unit(z[a:b]).mean(0))).sum() / (b - a) for a, b in [(0, 400)])
    assert good < 0.25 * poor and best < good
    again = harmony.parallel_start(table.repartition(3), 12)
    assert np.allclose(found["M1"], again["M1"])
    same = table.withColumn("zc", F.array(*(F.lit(1.0) for _ in range(8))))
    assert harmony.parallel_start(same, 5)["M1"].shape == (1, 8)  # one direction, one centre


def test_parallel_start_corrects(spark):
    rng = np.random.default_rng(5)
    group, batch, z = planted(rng)
    scores = spark.createDataFrame([(i, "M1", z[i].tolist()) for i in range(120)], "cell long, module string, z array<double>")
    cells = spark.createDataFrame([(i, f"b{batch[i]}") for i in range(120)], "cell long, batch string")
    have = np.array([r["z"] for r in harmony.harmony(scores, cells, ["batch"], rounds=3, inner=3, start="parallel").orderBy("cell").collect()])
    apart = lambda x: np.mean([np.linalg.norm(x[(group == g) & (batch == 0)].mean(0) - x[(group == g) & (batch == 1)].mean(0)) for g in (0, 1)])
    assert apart(have) < 0.4 * apart(z) and np.linalg.norm(have[group == 0].mean(0) - have[group == 1].mean(0)) > 4
