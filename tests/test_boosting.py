import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coexnet.operators import boosting


def long(spark, x):
    rows = [(f"c{j:03d}", f"g{i}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "cell string, gene string, value double")


def grow(x, y, f, use, depth, eta):
    """One tree by trying every split of every node: (steps of all cells, [(regulator, gain, cover)])."""
    part = lambda v: v.sum() ** 2 / (len(v) + 1)
    g, step, used = y - f, np.zeros(len(y)), []
    todo = [(np.ones(len(y), bool), 0)]
    while todo:
        here, level = todo.pop()
        rows = np.flatnonzero(here & use)
        best = (0.0, "", 0, None)
        if level < depth:
            for i in range(len(x)):
                for c in np.unique(x[i, rows])[:-1]:
                    low = rows[x[i, rows] <= c]
                    gain = round(part(g[low]) + part(g[rows[x[i, rows] > c]]) - part(g[rows]), 9)
                    if gain > 1e-9:
                        best = max(best, (gain, f"g{i}", c, i))
        if best[3] is None:
            step[here] = eta * g[rows].sum() / (len(rows) + 1)
        else:
            gain, name, c, i = best
            used.append((name, gain, len(rows)))
            todo += [(here & (x[i] <= c), level + 1), (here & (x[i] > c), level + 1)]
    return step, used


def brute(x, y, fold, rounds, depth=3, eta=0.3, folds=5, patience=10):
    f = np.full((folds + 1, len(y)), y.mean())
    rmse, stats = [], []
    for _ in range(rounds):
        for k in range(folds + 1):
            step, used = grow(x, y, f[k], fold != k, depth, eta)
            f[k] += step
            if k == 0:
                stats.append(used)
        rmse.append(np.mean([np.sqrt(np.square((y - f[k])[fold == k]).mean()) for k in range(1, folds + 1)]))
        if len(rmse) - 1 - int(np.argmin(rmse)) >= patience:
            break
    best = int(np.argmin(rmse)) + 1
    gain, cover, n = {}, {}, {}
    for used in stats[:best]:
        for name, g, c in used:
            gain[name], cover[name], n[name] = gain.get(name, 0) + g, cover.get(name, 0) + c, n.get(name, 0) + 1
    share = lambda d: {k: v / sum(d.values()) for k, v in d.items()}
    return rmse, best, share(gain), share(cover), share(n)


def test_rounds_and_importance_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (4, 90)).astype(float)
    y = [3 * (x[0] > 2) + (x[1] > 1) + rng.normal(0, 0.4, 90), rng.poisson(1, 90) + 0.5 * rng.random(90)]
    expr = long(spark, [*x, *y])
    motifs = spark.createDataFrame([(f"g{i}", g) for g in ("g4", "g5") for i in range(4)] + [("g4", "g4"), ("g0", "g4"), ("none", "g5"), ("g1", "g0")], "tf string, gene string")
    fold = np.array([r["f"] for r in expr.select("cell").distinct().orderBy("cell").select((F.pmod(F.xxhash64(F.lit("fold"), "cell"), F.lit(5)) + 1).alias("f")).collect()])
    links, errors = boosting.boost(expr, motifs, rounds=9, patience=3, chunk_cells=20)
    links, errors = links.collect(), errors.collect()
    for t, gene in enumerate(("g4", "g5")):
        rmse, best, gain, cover, n = brute(x, y[t], fold, 9, patience=3)
        got = sorted((r["round"], r["rmse"], r["best"]) for r in errors if r["gene"] == gene)
        assert np.allclose([e for _, e, _ in got][: len(rmse)], rmse) and [r for r, _, b in got if b] == [best]
        mine = {r["tf"]: r for r in links if r["gene"] == gene}
        assert set(mine) == set(gain)
        for tf, r in mine.items():
            assert math.isclose(r["gain"], gain[tf], abs_tol=1e-6) and math.isclose(r["cover"], cover[tf]) and math.isclose(r["frequency"], n[tf])
    assert {r["gene"] for r in links} == {"g4", "g5"}  # g0 has one regulator


def test_without_folds_and_without_links(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (2, 50)).astype(float)
    y = 2 * x[0] + rng.normal(0, 0.1, 50)
    expr = long(spark, [*x, y])
    motifs = spark.createDataFrame([("g0", "g2"), ("g1", "g2")], "tf string, gene string")
    links, errors = boosting.boost(expr, motifs, rounds=2, depth=2, folds=0)
    f, gain = np.full(50, y.mean()), {}
    for _ in range(2):
        step, used = grow(x, y, f, np.ones(50, bool), 2, 0.3)
        f += step
        for name, g, _ in used:
            gain[name] = gain.get(name, 0) + g
    got = {r["tf"]: r["gain"] for r in links.collect()}
    assert errors.count() == 0 and all(math.isclose(got[k], v / sum(gain.values()), abs_tol=1e-6) for k, v in gain.items())
    assert all(t.count() == 0 for t in boosting.boost(expr, motifs.limit(0), rounds=1))


def test_what_a_level_emits_does_not_grow_with_cells(spark):
    rng = np.random.default_rng(7)
    motifs = spark.createDataFrame([("g0", "g2"), ("g1", "g2")], "tf string, gene string")
    rows = []
    for n in (100, 1000):
        expr = long(spark, np.concatenate([rng.integers(0, 4, (2, n)), rng.random((1, n))]).astype(float))
        state = boosting.packed_state(expr, motifs, 8, 5, chunk_cells=10).coalesce(1)
        assert state.count() >= n / 20
        sums = state.withColumns({"splits": F.lit(None).cast("string"), "stopped": F.lit(None).cast("string")}).mapInArrow(boosting._histograms(6, 0, 17, 0.3), "gene string, model int, tf string, node int, bin int, g double, n long")
        rows.append(sums.count())
    assert rows[0] == rows[1] == 6 * 2 * 4


def test_the_state_is_neither_shuffled_nor_written_in_each_round(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, (3, 80)).astype(float)
    expr = long(spark, [*x, 2 * (x[0] > 2) + rng.normal(0, 0.3, 80), x[1] + rng.normal(0, 2, 80)])
    motifs = spark.createDataFrame([(f"g{i}", g) for g in ("g3", "g4") for i in range(3)], "tf string, gene string")
    plans, kept = [], boosting.keep

    def keep(df):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df)

    def told():
        links, errors = boosting.boost(expr, motifs, rounds=5, patience=2, chunk_cells=20)
        return sorted((r["tf"], r["gene"], round(r["gain"], 9), round(r["cover"], 9)) for r in links.collect()), sorted((r["gene"], r["round"], round(r["rmse"], 9), r["best"]) for r in errors.collect())

    monkeypatch.setattr(boosting, "keep", keep)
    often = told()
    assert sum("f" in columns for columns, _ in plans) == 1
    assert len([1 for columns, _ in plans if "gl" in columns]) == 15 and not any("Join" in plan for columns, plan in plans if "gl" in columns)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)
    plans.clear()
    assert told() == often and sum("f" in columns for columns, _ in plans) == 3


def test_kinds_of_cells_give_what_cells_give(spark, monkeypatch):
    """A state of kinds has no more of them when the same cells come again, and the trees are those of all cells."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (3, 60)).astype(float)
    x = np.concatenate([x, [2 * (x[0] > 2) + rng.normal(0, 0.3, 60), (x[1] > 1) * x[2] + rng.normal(3, 1, 60), rng.random(60)]])
    motifs = spark.createDataFrame([("g0", "g3"), ("g1", "g3"), ("g0", "g4"), ("g1", "g4"), ("g2", "g4"), ("g3", "g5"), ("g4", "g5")], "tf string, gene string")

    def told(expr):
        links, errors = boosting.boost(expr, motifs, rounds=6, patience=3, chunk_cells=50)
        return sorted((r["tf"], r["gene"], round(r["gain"], 9), round(r["cover"], 9), r["frequency"]) for r in links.collect()), sorted((r["gene"], r["round"], round(r["rmse"], 9), r["best"]) for r in errors.collect())

    held = []
    for copies in (4, 12):
        state = boosting.packed_state(long(spark, np.tile(x, copies)), motifs, 8, 1, chunk_cells=50)
        held.append({r["gene"]: r["n"] for r in boosting.by_kind(state, 17, 2).groupBy(F.get_json_object("info", "$.targets[0].name").alias("gene")).agg(F.sum(F.length("folds")).alias("n")).where("gene = 'g3'").collect()})
    assert held[0] == held[1] and held[0]["g3"] <= 16
    monkeypatch.setattr(boosting, "CHUNK_KINDS", 7)
    monkeypatch.setattr(boosting, "KIND_SHARE", 0)  # all targets
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)
    kinds = told(long(spark, np.tile(x, 3)))
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 10)
    monkeypatch.setattr(boosting, "KIND_SHARE", 1 << 40)  # none
    assert kinds == told(long(spark, np.tile(x, 3))) and len(kinds[0]) == 7


def test_steps_looked_up_by_answers_equal_a_walk_down_the_tree():
    """Trees of depth 3 have a table of steps by the answers to their splits, larger ones are walked; both give each cell its leaf's step."""
    rng = np.random.default_rng(10)
    bins = rng.integers(0, 9, (3, 200)).astype(np.uint8)
    info = json.dumps({"targets": [{"name": "t", "start": 0.5, "own": ["a", "b", "c"]}], "tfs": [{"name": x, "zero": 0} for x in "abc"]})
    row = {"info": info, "folds": np.ones(200, np.uint8).tobytes(), "bins": bins.tobytes(), "y": np.zeros(200).tobytes()}
    for depth in (0, 1, 3, 4):
        nodes = [n for n in range(1, max(2, 1 << depth)) if n < 4 or n % 3 or depth == 4]
        splits = [{"gene": "t", "model": 0, "node": n, "tf": "abc"[n % 3] if depth else None, "at": n % 7 + 1 if depth else None, "gl": float(n), "nl": 10, "ga": 30.0 + n, "na": 30} for n in nodes]
        trees = boosting.Trees(pa.Table.from_pylist(splits, pa.schema([("gene", pa.string()), ("model", pa.int32()), ("node", pa.int32()), ("tf", pa.string()), ("at", pa.int32()), ("gl", pa.float64()), ("nl", pa.int64()), ("ga", pa.float64()), ("na", pa.int64())])))
        by_node, want = {x["node"]: x for x in splits}, []
        for cell in bins.T:
            node, step = 1, 0.3 * by_node[1]["ga"] / 31
            while (x := by_node.get(node)) and x["tf"]:
                high = cell["abc".index(x["tf"])] > x["at"]
                step = 0.3 * (x["ga"] - x["gl"]) / 21 if high else 0.3 * x["gl"] / 11
                node = 2 * node + int(high)
            want.append(0.5 + step + step)
        assert np.allclose(boosting._Block(row, 1, [trees, trees]).fitted(0, 0, 0.3), want, atol=1e-15)
        assert (trees.plan("t", 0, 0.3)[3] is None) == (depth == 4)
