import numpy as np
import pytest

from coexnet.operators import clustering, tree_cut


def planted(spread=(0.3, 0.5, 0.8), grey=25, n=80, seed=5):
    """Topological overlaps of modules of unequal tightness, and which gene is in which."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=n) + s * rng.normal(size=(25 + 5 * i, n)) for i, s in enumerate(spread)] + [rng.normal(size=(grey, n))])
    truth = np.repeat([*range(1, len(spread) + 1), 0], [25 + 5 * i for i in range(len(spread))] + [grey])
    a = ((1 + np.corrcoef(x)) / 2) ** 8
    np.fill_diagonal(a, 0)
    k = a.sum(1)
    return np.clip((a @ a + a) / (np.minimum(k[:, None], k) + 1 - a), 0, 1), truth


def names(n):
    return [f"g{i:03d}" for i in range(n)]


def table(spark, t):
    g = names(len(t))
    return spark.createDataFrame([(g[j], g[i], float(t[i, j])) for i in range(len(t)) for j in range(i + 1, len(t))], "g1 string, g2 string, tom double")


def cut(spark, t, **kw):
    d = 1 - t
    np.fill_diagonal(d, 0)
    rows = tree_cut.hybrid_cut(table(spark, t), names(len(t)), clustering.average_linkage(d), **kw).collect()
    got = {r["gene"]: r["module"] for r in rows}
    assert len(rows) == len(got) == len(t)
    return [0 if got[g] == "grey" else int(got[g][1:]) for g in names(len(t))]


def brute_branches(d, z, deep, cut_height, least):
    """The published rule by recursion from the top: (clusters, small groups, cut height)."""
    n = len(d)
    h = z[:, 2]
    low, high = h[max(1, round((n - 1) * 0.05)) - 1], h[-1]
    cut = low + 0.99 * (high - low) if cut_height is None else min(cut_height, high)
    share = [0.64, 0.73, 0.82, 0.91, 0.95][deep]
    most, gap = low + share * (cut - low), 0.75 * (1 - share) * (cut - low)

    def scatter(genes):
        base = least / 2 + 1
        core = genes[: int(base + np.sqrt(len(genes) - base))] if base < len(genes) else genes
        return np.mean([d[i, j] for i in core for j in core if i != j])

    ended, small = [], []  # (genes, end)

    def branch(node):
        """(genes or None for one of several clusters, size)."""
        if node < n:
            return [node], 1
        a, b, height, _ = z[node - n]
        sides = [branch(int(a)), branch(int(b))]
        if height > cut:
            for genes, size in sides:
                if genes is not None and size > 1:
                    ended.append((genes, cut))
            return None, 0
        if 0 in (sides[0][1], sides[1][1]):
            raise AssertionError
        if sides[0][1] == 1 or sides[1][1] == 1:
            (g1, s1), (g2, s2) = sides if sides[1][1] == 1 else sides[::-1]
            return (None if g1 is None else g1 + g2), s1 + s2
        small_one, large = (sides[0], sides[1]) if sides[0][1] < sides[1][1] else (sides[1], sides[0])
        for lost, kept in ((small_one, large), (large, small_one)):
            genes, size = lost
            if genes is None:
                continue
            shape = scatter(genes) > most or height - scatter(genes) < gap
            if size < least or shape:
                if not shape:
                    small.append(genes)
                return (None if kept[0] is None else kept[0] + genes), size + kept[1]
        for genes, _ in sides:
            if genes is not None:
                ended.append((genes, height))
        return None, small_one[1] + large[1]

    top = branch(2 * n - 2)
    if h[-1] <= cut and top[0] is not None:
        ended.append((top[0], cut))
    clusters = [g for g, end in ended if len(g) >= least and scatter(g) < most and end - scatter(g) > gap]
    return clusters, small, cut


def brute_cut(d, z, deep, cut_height, least, pam=True):
    clusters, small, cut = brute_branches(d, z, deep, cut_height, least)
    clusters = sorted(clusters, key=min)
    label = np.zeros(len(d), int)
    for i, c in enumerate(clusters, 1):
        label[c] = i
    new = label.copy()
    if pam and clusters:
        diameter = [max(d[i, [j for j in c if j != i]].mean() for i in c) for c in clusters]
        barred = set()
        for genes in [[g] for g in range(len(d))] if not small else [s for s in small] + [[g] for g in range(len(d))]:
            free = [g for g in genes if label[g] == 0]
            if not free or (len(genes) == 1 and genes[0] in barred):
                continue
            if len(genes) > 1:
                barred |= set(free)
            far = [d[np.ix_(free, c)].mean() for c in clusters]
            best = int(np.argmin(far))
            if far[best] < max(diameter[best], cut):
                new[free] = best + 1
    order = sorted(set(new) - {0}, key=lambda c: (-(new == c).sum(), np.flatnonzero(new == c)[0]))
    return [order.index(c) + 1 if c else 0 for c in new]


@pytest.mark.parametrize("deep", range(5))
def test_planted_modules_of_unequal_tightness(spark, deep):
    t, truth = planted((0.2, 0.35, 0.5))
    got = cut(spark, t, deep_split=deep, cut_height=None, min_size=15, pam=False)
    inside = [{g for g, x in zip(got, truth, strict=True) if x == m} for m in (1, 2, 3)]
    assert all(len(x) == 1 for x in inside) and len(set.union(*inside) - {0}) == 3
    loosest = {g for g, x in zip(cut(spark, planted()[0], deep_split=deep, cut_height=None, min_size=15, pam=False), truth, strict=True) if x == 3}
    assert (loosest == {0}) == (deep == 0)  # a module with a noise of 0.8 is too loose for the strictest setting only
    d = 1 - t
    np.fill_diagonal(d, 0)
    assert got == brute_cut(d, clustering.average_linkage(d), deep, None, 15, pam=False)


@pytest.mark.parametrize("seed,deep,height,least", [(1, 4, 0.995, 10), (2, 2, 0.9, 6), (3, 0, None, 8), (4, 3, 0.93, 5)])
def test_cut_and_distances_against_plain_loops(spark, seed, deep, height, least):
    t, _ = planted((0.4, 0.6, 0.9, 1.1), 40, 30, seed)
    d = 1 - t
    np.fill_diagonal(d, 0)
    z = clustering.average_linkage(d)
    want = brute_cut(d, z, deep, height, least)
    assert cut(spark, t, deep_split=deep, cut_height=height, min_size=least) == want
    assert want.count(0) <= brute_cut(d, z, deep, height, least, pam=False).count(0)


def test_groups_too_small_go_together(spark):
    rng = np.random.default_rng(8)
    t = 0.05 + 0.01 * rng.random((34, 34))
    for a, b, s in ((0, 14, 0.8), (14, 28, 0.7), (28, 33, 0.75)):
        t[a:b, a:b] = s + 0.02 * rng.random((b - a, b - a))
    t[28:33, 14:28] = t[14:28, 28:33] = 0.2
    t[30, :14] = t[:14, 30] = 0.3  # alone it would go elsewhere
    t = (t + t.T) / 2
    got = cut(spark, t, deep_split=1, cut_height=0.9, min_size=10)
    assert len(set(got[:14])) == len(set(got[14:33])) == 1 and got[0] != got[14] and got[33] == 0
    d = 1 - t
    np.fill_diagonal(d, 0)
    assert got == brute_cut(d, clustering.average_linkage(d), 1, 0.9, 10)
    within = cut(spark, t, deep_split=1, cut_height=0.9, min_size=10, within_branch=True)
    assert within[:28] == got[:28]


def test_edges(spark):
    empty = spark.createDataFrame([], "g1 string, g2 string, tom double")
    assert tree_cut.hybrid_cut(empty, [], np.zeros((0, 4))).count() == 0
    t = np.full((6, 6), 0.5)  # all ties
    assert set(cut(spark, t, min_size=20)) == {0} and len(cut(spark, t, min_size=2, cut_height=None)) == 6
    with pytest.raises(ValueError, match="deep_split"):
        cut(spark, t, deep_split=5)
    with pytest.raises(ValueError, match="unknown cut"):
        clustering.detect_modules(empty, "other")


def test_again_at_its_own_height_if_all_is_grey(spark):
    t, _ = planted((0.3,), 8, 60)
    tom = table(spark, t[:30, :30])
    assert clustering.detect_modules(tom, "hybrid", cut_height=0.01, min_size=10).where("module = 'M1'").count() >= 10


def test_dendrogram_equals_plain_recursion(spark):
    rng = np.random.default_rng(12)
    d = rng.random((9, 9))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    z = clustering.average_linkage(d)

    def leaves(x):
        return [x] if x < 9 else leaves(int(z[x - 9, 0])) + leaves(int(z[x - 9, 1]))

    order = leaves(16)
    middle = lambda x: float(order.index(x)) if x < 9 else (middle(int(z[x - 9, 0])) + middle(int(z[x - 9, 1]))) / 2
    for hang in (0.1, -1):
        places, lines = (t.collect() for t in clustering.dendrogram(table(spark, 1 - d), hang))
        assert [r["gene"] for r in sorted(places, key=lambda r: r["place"])] == [names(9)[x] for x in order]
        got = {(r["step"], r["part"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in lines}
        for k, (a, b, h, _) in enumerate(z):
            foot = lambda x, h=h: z[x - 9, 2] if x >= 9 else max(0, h - hang * z[-1, 2]) if hang >= 0 else 0  # noqa: B023, E731
            xa, xb = middle(int(a)), middle(int(b))
            assert np.allclose(got[k, "left"], (xa, foot(int(a)), xa, h)) and np.allclose(got[k, "bar"], (xa, h, xb, h)) and np.allclose(got[k, "right"], (xb, h, xb, foot(int(b))))
    empty = spark.createDataFrame([], "g1 string, g2 string, tom double")
    assert all(t.count() == 0 for t in clustering.dendrogram(empty))
