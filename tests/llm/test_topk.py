import numpy as np
import pytest

from coexnet.llm import topk


def brute(ids, x, asked, k):
    out = {}
    for q, v in asked:
        s = sorted(((-int(v @ w), int(i)) for i, w in zip(ids, x, strict=True) if i != q))[:k]
        out[q] = [(i, -t) for t, i in s]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_threshold_algorithm(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3 if seed % 2 else -200, 4 if seed % 2 else 200, (rng.integers(1, 400), 6))
    if seed > 5:
        x[: len(x) // 2] = x[0]
    ids = rng.permutation(len(x)) * 3
    lists = topk.sorted_lists(x.astype(float), ids)
    for q in (0, len(x) // 2):
        at, s, _ = topk.threshold_topk(x.astype(float), ids, lists, x[q].astype(float), 5, ids[q])
        assert list(zip(ids[at].tolist(), s.astype(int).tolist())) == brute(ids, x, [(ids[q], x[q])], 5)[ids[q]]


def test_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (20_000, 3))
    q = np.array([1.0, 0.5, -0.2])
    assert topk.threshold_topk(x, np.arange(len(x)), topk.sorted_lists(x, np.arange(len(x))), q, 5, -1)[2] < 5000


def test_blocks_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (300, 4))
    x[100:200] = x[100]  # a hot vector
    rows = [(i, x[i].tolist(), 1, 2) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, [1, 1, 1, 1], 0, 0), (900, None, 0, 0), (901, [1, None, 0, 0], 0, 0)], "vec_id long, vector array<long>, id long, rank int")
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, candidate_rows=64, query_rows=2).collect()
    want = brute(np.arange(300), x, [(q, x[q]) for q in range(0, 300, 50)], 5)
    assert {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    assert topk.exact_topk(df.limit(0), df.limit(0), 5).count() == 0
    uneven = spark.createDataFrame([(0, [2, 3]), (1, [1]), (2, []), (2, [0, 0, 5])], "vec_id long, vector array<long>")
    got = topk.exact_topk(uneven, uneven.where("vec_id = 0"), 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2), (2, 2, 0), (3, 2, 0)]


def test_starts_from_a_bound_and_tells_what_it_scored(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(0, 1, (4000, 6)) * [900, 300, 40, 10, 3, 1]).astype(int)
    x[1000:2400] = x[1000]  # a third of the rows is one vector
    rows = [(i, x[i].tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, candidate_rows=500, query_rows=30, with_scored=True).collect()
    want = brute(np.arange(4000), x, [(q, x[q]) for q in range(0, 4000, 50)], 5)
    assert {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    assert sum(r["scored"] for r in got) < 0.6 * sum(r["candidates"] for r in got)
    ids = np.arange(4000)
    lists = topk.sorted_lists(x.astype(float), ids)
    free = topk.threshold_topk(x.astype(float), ids, lists, x[7].astype(float), 5, 7)
    bound = topk.threshold_topk(x.astype(float), ids, lists, x[7].astype(float), 5, 7, free[1][-1])
    assert bound[2] <= free[2] and bound[0].tolist() == free[0].tolist()


def test_large_ids_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62 + i, [i, 1]) for i in range(60)] + [(-(2**62), [3, 1])] * 3, "vec_id long, vector array<long>").repartition(40)
    got = topk.exact_topk(df, df.limit(4), 3, candidate_rows=7)
    assert got.count() == 12 or got.groupBy("query_id").count().where("count > 3").count() == 0


def test_quantise(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf")],), (None,), ([None, 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(topk.quantise(F.col("v"))).collect()] == [[128, -1], None, None, None, None]
