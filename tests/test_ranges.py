import math
import random

import numpy as np
from pyspark.sql import functions as F

from coexnet.functions import stats
from coexnet.operators import correlation, ranges


def dealt(spark, rows, parts, seed):
    """Rows (group, order, value) in ranges cut anywhere."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1]))
    cuts = sorted(rng.randrange(len(rows)) for _ in range(parts - 1))
    return spark.createDataFrame([(*r, sum(c <= i for c in cuts)) for i, r in enumerate(rows)], "g string, o int, v int, __part int")


def test_running_over_ranges_cut_anywhere(spark):
    rng = random.Random(1)
    rows = [(g, o, rng.randrange(-5, 9)) for g in ("hot", "b", None) for o in range(150 if g == "hot" else 7)]
    for seed in range(4):
        for least in (False, True):
            for backwards in (False, True):
                got = ranges.running(dealt(spark, rows, 9, seed), ["g"], "o", "v", "out", least, backwards).collect()
                fold = min if least else sum
                want = {(g, o): fold(v for h, p, v in rows if h == g and (p >= o if backwards else p <= o)) for g, o, _ in rows}
                assert {(r["g"], r["o"]): r["out"] for r in got} == want
    alone = ranges.running(dealt(spark, [("x", o, 1) for o in range(20)], 5, 2), [], "o", "v", "out").collect()
    assert all(r["out"] == r["o"] + 1 for r in alone)


def test_ranks_and_rank_sums_of_one_group_with_most_rows(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else f"s{i % 3}", float(rng.randrange(40)), i % 2 == 0) for i in range(900)] + [(None, 1.0, True), (None, 1.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, one boolean")
    by = {}
    for g, v, one in rows:
        by.setdefault(g, []).append((v, one))
    rank = {g: {v: sum(x < v for x, _ in xs) + (sum(x == v for x, _ in xs) + 1) / 2 for v, _ in xs} for g, xs in by.items()}
    assert all(r["rk"] == rank[r["g"]][r["v"]] for r in stats.mean_ranks(df, ["g"], "v").collect())
    assert stats.mean_ranks(df, ["g"], "v").count() == len(rows)
    for r in stats.rank_sum(df, ["g"], "v", F.col("one")).collect():
        xs = by[r["g"]]
        n1, n2, n = sum(o for _, o in xs), sum(not o for _, o in xs), len(xs)
        u = sum(rank[r["g"]][v] for v, o in xs if o) - n1 * (n1 + 1) / 2
        ties = sum(t**3 - t for t in (sum(x == v for x, _ in xs) for v in {v for v, _ in xs}))
        sd = math.sqrt(max(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))), 0))
        assert (r["n1"], r["n2"], r["u1"]) == (n1, n2, u)
        assert math.isclose(r["z"], (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd if sd else 0.0, abs_tol=1e-12)


def test_benjamini_hochberg_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("a", None)), i, rng.choice((None, 0.5, round(rng.random() ** 3, 2)))) for i in range(300)]
    for by in ([], ["f"]):
        got = {r["k"]: r["q"] for r in stats.bh(spark.createDataFrame(rows, "f string, k int, p double"), "p", by, "q").collect()}
        for f in ("a", None) if by else ("all",):
            mine = sorted((1.0 if p is None else p, k) for g, k, p in rows if not by or g == f)
            low = 1.0
            for r in range(len(mine), 0, -1):
                low = min(low, mine[r - 1][0] * len(mine) / r)
                assert math.isclose(got[mine[r - 1][1]], low)


def test_biweight_of_mostly_zeros(spark):
    """Medians at and off zero, negative values, a constant gene and one of NaN; no row is made for an absent value."""
    rng = np.random.default_rng(6)
    x = rng.poisson(0.7, (9, 61)) * rng.choice([1.0, 2.5, -1.0], (9, 61))
    x[1:4] += rng.poisson(3, (3, 61))
    x[4] = 2.0
    x[5] = 0.0
    x[5, 3] = 4.0
    rows = [(j, f"g{i}", float(x[i, j])) for i in range(9) for j in range(61) if x[i, j]]
    expr = spark.createDataFrame([*rows, (0, "g8x", 0.0)], "cell int, gene string, value double")
    med = np.median(x, 1, keepdims=True)
    mad = np.median(abs(x - med), 1, keepdims=True)
    u = (x - med) / (9 * np.where(mad < 1e-15, 1, mad))
    z = np.where(abs(u) < 1, (x - med) * (1 - u**2) ** 2, 0)
    z /= np.where(np.linalg.norm(z, axis=1, keepdims=True) < 1e-15, 1, np.linalg.norm(z, axis=1, keepdims=True))
    z = np.vstack([z, np.zeros(61)])
    names = [*(f"g{i}" for i in range(9)), "g8x"]
    values, base = correlation.biweight(expr, 61)
    assert values.count() == len(rows) and base.count() == 10
    for plan in ("relational", "blocked"):
        got = {(r["g1"], r["g2"]): r["cor"] for r in correlation.bicor(expr, 61, plan).collect()}
        assert len(got) == 45 and all(math.isclose(c, float(z[names.index(a)] @ z[names.index(b)]), abs_tol=1e-9) for (a, b), c in got.items())
