import math
import re

import pytest
from pyspark.sql import functions as F

from coexnet.llm import mix

SCHEMA = "doc_id long, text string, source string, size long, taken string"


def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, fixed, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        now = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if now[k] > 2 * sizes[k] + 1e-9]
        if not over:
            return fixed | now
        for k in over:
            fixed[k] = 2 * sizes[k]
            left -= fixed[k]
            free.discard(k)
    return fixed


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 3, None: 50, "z": 0}, {"a": 1}, {"b": 2, "ä": 900, "Z": 40, "z": 40, "y": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mix.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in sizes)


def run(spark, rows, weight=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return mix.mix(df, F.lit(1.0) if weight is None else weight).collect()


def test_shares_and_reruns(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i % 7), "hot" if i % 3 else f"s{i % 5}", 0, "x") for i in range(900)]
    a, b = run(spark, rows), run(spark, rows[::-1])
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    by = {}
    for r in a:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        t = by.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        t[0] += r["taken"]
        t[3] += r["size"]
    for taken, target, size, total in by.values():
        assert abs(taken - target) <= 4 and size == total


def test_order_is_efraimidis_spirakis(spark):
    rows = [(i, "a b c", "s", 0, "") for i in range(200)] + [(1000 + i, "a b c", "t", 0, "") for i in range(300)]
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)
    got = run(spark, rows, weight)
    df = spark.createDataFrame(rows, SCHEMA)
    key = {r[0]: r[1] for r in df.select("doc_id", mix.sampling_key(F.col("doc_id"), weight)).collect()}
    for s in "st":
        mine = sorted((key[r["doc_id"]], r["taken"]) for r in got if r["source"] == s)
        taken = [t for _, t in mine]
        assert taken == sorted(taken, reverse=True)  # smaller keys are taken as often or more
    t = [r for r in got if r["source"] == "t"]
    even = sum(r["taken"] for r in t if r["doc_id"] % 2 == 0)
    assert even > 1.05 * sum(r["taken"] for r in t) / 2


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, 1, ""), (None, "a", None, 1, ""), (3, "", "s", 1, ""), (4, " \t\x0b", "s", 1, ""), (5, "a\x0bb c", "t", 1, ""), (5, "a\x0bb c", "t", 1, ""), (6, "q" * 100_000, "t", 1, "")]
    got = run(spark, rows, F.lit(None).cast("double"))
    assert len(got) == 7 and sorted(r["size"] for r in got) == [0, 0, 0, 1, 1, 2, 2]
    assert all(r["taken"] == 0 and r["target"] == 0 for r in got if r["source"] == "s")


def test_query(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in mix.op2_mix(spark, sf).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]


def test_ranges_of_keys_are_small_for_all_weights(spark):
    for weight in (0.0, 0.05, 0.3, 1.0, 40.0):
        ids = spark.range(100_000).withColumn("r", mix.key_range(mix.sampling_key(F.col("id"), F.lit(weight))))
        assert ids.groupBy("r").count().agg(F.max("count")).first()[0] < 300, weight
