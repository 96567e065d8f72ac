import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coexnet.llm import quality


def test_features_do_not_depend_on_the_batch():
    texts = pa.array(["One two. Three!", None, "", "é" * 50 + "\nA\nA", "spam spam spam spam", "x" * 200_000])
    whole = quality.features(texts)
    parts = np.concatenate([quality.features(texts.slice(i, 1)) for i in range(len(texts))])
    assert whole.shape == (6, quality.FEATURES) and np.isfinite(whole).all()
    assert np.allclose(whole, parts) and np.allclose(quality.features(texts.slice(2, 3)), whole[2:5])


def test_risk_separates_hidden_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (4000, 4)), rng.normal(-3, 1, (1000, 4))
    model = quality.PuNetwork(0.8).fit(good[:2000], np.concatenate([good[2000:], bad[:500]]), steps=800)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad[500:]) < 0.5).mean() > 0.95


def test_held_out_accuracy_and_determinism(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op7_quality(spark, d).collect()
    again = {r["doc_id"]: r["score"] for r in quality.op7_quality(spark, d).collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)
    held = [r for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text, here.", 5.0), (2, None, 1.0), (None, "", 2.0), (1, "good text, here.", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    always = lambda c: F.lit(True)
    model = quality.fit_quality(docs, labels, always)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, model).collect())
    none = quality.fit_quality(docs, labels.limit(0), always)
    assert [r["score"] for r in quality.score_quality(docs, none).collect()] == [0.5] * 4
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.fit_quality(docs.limit(0), labels, always).w is None


def test_risk_and_gradient_by_definition():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.9):
        gp, gu = rng.normal(0.5, 1, 40), rng.normal(-0.5, 1, 60)
        loss = lambda g, sign: np.mean([1 / (1 + np.exp(sign * x)) for x in g])
        rest = lambda gp, gu: loss(gu, -1) - prior * loss(gp, -1)
        risk, grad = quality.pu_risk(gp, gu, prior)
        assert np.isclose(risk, prior * loss(gp, 1) + max(0, rest(gp, gu)))
        target = (lambda gp, gu: prior * loss(gp, 1) + rest(gp, gu)) if rest(gp, gu) >= 0 else (lambda gp, gu: -rest(gp, gu))
        for i in (0, 39, 40, 99):
            up, down = np.concatenate([gp, gu]), np.concatenate([gp, gu])
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            assert np.isclose((target(up[:40], up[40:]) - target(down[:40], down[40:])) / 2e-5, grad[i], rtol=1e-3, atol=1e-9)


def test_scores_and_prior_against_plain_numpy(spark):
    """One shard: the fit in Spark is the fit on the whole matrix; ids that repeat count once; labels of 0 don't matter."""
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["river", "stone", "walks", "slowly", "home."], 30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$$", "buy!!", "NOW", "###"], 30)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows + [rows[3]] * 300, "doc_id long, text string").repartition(4)
    labels = [(i, 1) for i in range(60)]
    learn = lambda c: F.lit(True)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    model = quality.fit_quality(docs, frame(labels), learn)
    same = quality.fit_quality(docs, frame(labels + [(i, 0) for i in range(150, 200)]), learn)
    assert np.allclose(model.flat(), same.flat()) and 0.65 < model.prior < 0.85
    f = quality.features(pa.array([t for _, t in rows])).astype(np.float32).astype(float)
    x, p = f[np.lexsort(f.T[::-1])], f[:60]
    p = p[np.lexsort(p.T)]
    p = p[np.random.default_rng(quality.SEED).permutation(60)]
    plain = quality.PuNetwork(model.prior).start(f.mean(0), f.std(0))
    for r in range(quality.ROUNDS):
        plain.fit(p, x, r * quality.STEPS, quality.STEPS)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert np.allclose([got[i] for i, _ in rows], plain.score(f), atol=0.02)
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i, _ in rows]) > 0.95


def test_shards_learn_together(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["one", "two", "three,", "four."], 20)) if i % 4 else "!!! ### $$$ " * 9 for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(400) if i % 4 == 1], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, lambda c: F.lit(True), shard_rows=60)
    got = quality.score_quality(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got]) > 0.97


def test_a_task_is_a_shard(spark):
    rows = spark.range(0, 300_000, 1, 6).select("id", F.array(F.col("id").cast("float")).alias("f"))
    for shards in (1, 2, 16, 37):
        tasks = quality.deal(rows, shards).groupBy(F.spark_partition_id().alias("task")).agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.count("*").alias("n")).collect()
        assert sorted(t["a"] for t in tasks) == list(range(shards)) and all(t["a"] == t["b"] for t in tasks) and sum(t["n"] for t in tasks) == 300_000


def test_fits_agree_on_more_rows_than_a_sampled_range_sees(spark):
    id, n = F.col("id"), 60_000
    text = F.concat(F.repeat(F.lit("word "), (F.xxhash64("id") % 40 + 45).cast("int")), F.when(id % 5 == 0, F.lit("$$$ 12345 |||")).otherwise(F.lit("end, of it.")))
    docs = spark.range(0, n, 1, 7).select(id.alias("doc_id"), text.alias("text"))
    labels = spark.range(0, n, 50).select((id + 1).alias("doc_id"), F.lit(1).alias("quality"))
    fits = [quality.fit_quality(docs.repartition(k), labels, lambda c: F.lit(True), shard_rows=8_000, prior=0.8) for k in (7, 5, 9)]
    assert all(np.array_equal(f.flat(), fits[0].flat()) for f in fits)
