import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coexnet.llm import attention as at
from coexnet.llm import lm_score as lm


def model(seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    m = at.Attention.fresh(at.balanced_classes(rng.random((at.SYMBOLS, 2 * at.SYMBOLS))), rng.integers(1, 9, at.SYMBOLS))
    for k in ("query", "key", "value", "embed", "bias", "to_class", "to_member"):
        m.p[k] = (m.p[k] + rng.normal(0, scale, m.p[k].shape)).astype(np.float32)
    return m.frozen()


def test_gradients():
    m, rng = model(), np.random.default_rng(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, target = rng.integers(0, at.SYMBOLS, (3, at.SPAN)), rng.integers(0, at.SYMBOLS, (3, at.STRIDE))
    ids[0, : at.SPAN - at.STRIDE] = at.PAD  # what comes before a text; a predicted place is never one
    real = np.ones(target.shape, bool)
    real[1, 4:] = False
    g = m.gradients(ids, target, real)
    loss = lambda: -(m.frozen().log_prob(ids, target) * real).sum() / real.sum()
    for k, x in m.p.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep, e = x[i], 1e-4
        x[i] = keep + e
        up = loss()
        x[i] = keep - e
        assert math.isclose((up - loss()) / (2 * e), g[k][i], rel_tol=1e-3), k
        x[i] = keep


def plain_log_prob(m, ids, target):
    """One position at a time, over its window."""
    p, out = m.p, []
    for k, t in enumerate(target):
        i = at.SPAN - at.STRIDE + k
        seen = [j for j in range(i + 1) if ids[j] != at.PAD]
        a = np.array([p["query"][ids[i]] @ p["key"][ids[j]] / at.WIDTH**0.5 + p["bias"][i - j] for j in seen])
        a = np.exp(a - a.max())
        h = np.tanh(p["embed"][ids[i]] + (a / a.sum()) @ p["value"][[ids[j] for j in seen]])
        c, s = divmod(int(m.slot[t]), at.SIDE)
        lc = h @ p["to_class"] + p["class"]
        ls = (h * p["gate"][c]) @ p["to_member"] + p["member"][c]
        out.append(lc[c] - np.log(np.exp(lc - lc.max()).sum()) - lc.max() + ls[s] - np.log(np.exp(ls - ls.max()).sum()) - ls.max())
    return np.array(out)


def test_masked_attention_and_windows():
    m, rng = model(2), np.random.default_rng(3)
    flat = rng.integers(0, at.SYMBOLS, 150)
    start, length = np.array([0, 1, 1, 68]), np.array([1, 0, 67, 82])
    got = lm.symbol_logs(m, flat, start, length) * np.log(10)
    for s, n in zip(start, length, strict=True):
        x = np.concatenate([[at.START], flat[s : s + n - 1]]) if n else []
        for a in range(0, n, at.STRIDE):
            ids = [x[j] if 0 <= j < n else at.PAD for j in range(a + at.STRIDE - at.SPAN, a + at.STRIDE)]
            k = min(at.STRIDE, n - a)
            assert np.allclose(plain_log_prob(m, ids, flat[s + a : s + a + k]), got[s + a : s + a + k], atol=1e-4)


def test_adds_up_to_one_and_survives_large_logits():
    m = model(4)
    ids = np.random.default_rng(5).integers(0, at.SYMBOLS, (1, at.SPAN))
    total = sum(np.exp(m.log_prob(ids, np.full((1, at.STRIDE), v))[0, 3]) for v in range(at.SYMBOLS))
    assert math.isclose(total, 1, abs_tol=1e-4)
    big = model(6, 60.0)
    assert np.isfinite(big.log_prob(ids, np.zeros((1, at.STRIDE), int))).all()


def brute_base(rows, train):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    c = Counter()
    for i, t in rows:
        if train(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return {i: (len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = lm.score_texts(df, lambda c: F.crc32(c.cast("string")) % 7 != 2, rounds=1, shard_chars=50_000).collect()
    want = brute_base(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    return got


def test_base_and_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 2)
    monkeypatch.setattr(lm, "HOT_WORDS", 4)  # nearly all words take the join
    rows = [(i, f"Word{i % 5} the THE é{i} \x0b end.") for i in range(40)] + [(50, None), (51, ""), (None, "the unseen"), (52, "q" * 70_000), (53, "the " * 20_000)]
    got = check(spark, rows)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[50] == 1
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), lambda c: F.lit(True)).count() == 0
    only = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), lambda c: F.lit(False)).first()
    assert only["base_score"] == 0 and only["n_known"] == 0 and only["train_tokens"] == 0 and only["score"] < 0


def test_subword_shares_add_up():
    cut = lm.Subwords(lm.VOCABULARY)
    counts = np.zeros(cut.size + 1)
    counts[100:3000] = np.arange(2900)
    sym = lm.Symbols(counts)
    rare = sym.of == at.RARE
    assert math.isclose((10 ** sym.extra[rare]).sum(), 1, rel_tol=1e-9) and sym.of[-1] != at.RARE and (~rare).sum() == at.SYMBOLS - 1
    q = lm.Sequences(pa.array(["ab cd", None, " "]), cut, sym)
    assert q.n_words.tolist() == [3, 1, 1] and q.length.sum() == len(q.flat) == q.pieces.sum()


def test_all_text_is_learned_at_every_size(spark, monkeypatch):
    rows = [(i, f"start{i} " + "some more words, " * 40 * i + f"end{i}") for i in range(12)] + [(20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "LEAST_CHARS", 100)
    for most in (100, 10**9):  # a large corpus and a small one for the number of shards
        got, shards = lm.training_texts(docs, 2, most)
        assert sorted(r["text"] or "" for r in got.collect()) == sorted(t or "" for _, t in rows)
        assert shards == max(1, -(-sum(len(t or "") for _, t in rows) // (2 * most)))
    monkeypatch.setattr(lm, "LEAST_CHARS", 10**9)
    again = lm.training_texts(docs, 3, 10**9)[0].groupBy("text").agg(F.count_distinct("round").alias("n")).collect()
    assert len(again) == len(rows) and {r["n"] for r in again} == {3}
    cut = lm.Subwords(lm.VOCABULARY)
    sym = lm.Symbols(np.ones(cut.size + 1))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    parts = list(lm._text_windows(batch, cut, sym, 7))
    assert sum(int(real.sum()) for _, _, real in parts) == int(lm.Sequences(batch.column("text"), cut, sym).length.sum())


def test_neighbours_of_all_rounds_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_CHARS", 100)
    docs = spark.createDataFrame([(i, f"alpha beta gamma {i}") for i in range(30)], "doc_id long, text string")
    cut = lm.Subwords(lm.VOCABULARY)
    sym = lm.Symbols(np.ones(cut.size + 1))
    texts, _ = lm.training_texts(docs, 4)
    assert texts.select("round").distinct().count() == 4
    q = lm.Sequences(pa.array([r["text"] for r in texts.collect()]), cut, sym)
    assert lm.neighbour_counts(texts, lm.VOCABULARY, sym)[:, : at.SYMBOLS].sum() == q.length.sum() - len(q.length)


def test_parameters_add_up_in_blocks():
    rng = np.random.default_rng(3)
    rows = [(k, shard, int(w), rng.random(4).astype(np.float32)) for k in (0, 2) for shard, w in ((0, 3), (1, 5))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3].tobytes() for r in rows])], names=["block", "shard", "weight", "params"])
    out = next(lm._add_up([batch.slice(0, 1), batch.slice(1)])).to_pylist()
    for r in out:
        want = sum(x[2] * x[3].astype(float) for x in rows if x[0] == r["block"])
        assert r["weight"] == 8 and np.allclose(np.frombuffer(r["params"]), want)


def test_score_is_the_network_over_the_whole_text(spark, monkeypatch):
    """The query's scores against a plain walk of the trained model over each text, subword after subword."""
    monkeypatch.setattr(lm, "LEAST_STEPS", 20)
    made = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda texts, vocabulary, symbols, *a: made.setdefault("m", (train(texts, vocabulary, symbols, *a), symbols))[0])
    rows = [(i, f"some plain words {i} and Some more of them, {'again ' * (i % 4)}") for i in range(40)] + [(90, None), (91, "zxqj " * 60), (92, "\u200b odd \u200b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, lambda c: c < 30, rounds=2, shard_chars=500).collect()}
    m, sym = made["m"]
    m.frozen()
    cut = lm.Subwords(lm.VOCABULARY)
    for i, t in rows[::7] + rows[-3:]:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        ids = [x for w in words for x in cut.model.encode(w) or cut.unknown] + [cut.size]
        flat, want = sym.of[np.array(ids)], float(sym.extra[np.array(ids)].sum())
        x = np.concatenate([[at.START], flat[:-1]])
        for a in range(0, len(flat), at.STRIDE):
            seen = [x[j] if j >= 0 and j < len(x) else at.PAD for j in range(a + at.STRIDE - at.SPAN, a + at.STRIDE)]
            want += plain_log_prob(m, seen, flat[a : a + at.STRIDE]).sum() / np.log(10)
        assert math.isclose(got[i], want, rel_tol=1e-4), (i, got[i], want)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    nouns, verbs = ["garden", "river", "window", "letter"], ["opens", "follows", "keeps", "finds"]
    rows = [(i, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} ." for _ in range(12))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm.score_texts(df, lambda c: c < 150, rounds=2).where("doc_id >= 150").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > 0.7 * out["b"]


def test_networks_of_several_shards_agree(spark):
    words = F.array(*(F.lit(w) for w in "the cat sat on a mat and then some more".split()))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", k), F.lit(10)) + 1).cast("int"))), " ")
    docs = spark.range(0, 12_000, 1, 6).select(F.col("id").alias("doc_id"), text.alias("text"))
    texts, shards = lm.training_texts(docs, 1, 40_000)
    assert shards > 4
    symbols = lm.Symbols(lm.subword_counts(lm.word_counts(docs), lm.VOCABULARY, 12_000))
    models = [lm.train(t, lm.VOCABULARY, symbols, 1, shards, least_steps=1) for t in (texts, texts.repartition(5))]
    assert models[0].to_bytes() == models[1].to_bytes()


def test_runs_hold_whole_texts_and_train_alike(spark):
    rows = [(i, f"some plain words {i}, {'again ' * i}zxqj") for i in range(30)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = lm.Subwords(lm.VOCABULARY)
    sym = lm.Symbols(np.arange(cut.size + 1.0))
    texts, _ = lm.training_texts(docs, 1)
    runs = lm.symbol_runs(texts, lm.VOCABULARY, sym)
    got = {r["at"]: np.frombuffer(r["run"], np.uint16).tolist() for r in runs.collect()}
    for r in texts.collect():
        assert got[r["at"]] == lm.Sequences(pa.array([r["text"]], pa.string()), cut, sym).flat.tolist()
    q = lm.Sequences(pa.array([t for _, t in rows]), cut, sym)
    flat, start, length = lm.unpacked(lm.packed(q).slice(5, 20))
    assert flat.tolist() == q.flat[q.start[5] : q.start[25]].tolist() and length.tolist() == q.length[5:25].tolist() and (start == q.start[5:25] - q.start[5]).all()
    models = [lm.train(t, lm.VOCABULARY, sym, 1, 1, least_steps=2).to_bytes() for t in (texts, runs)]
    assert models[0] == models[1]


def test_steps_reuse_their_arrays():
    m, rng = model(7), np.random.default_rng(8)
    ids, target = rng.integers(0, at.SYMBOLS, (5, at.SPAN)), rng.integers(0, at.SYMBOLS, (5, at.STRIDE))
    size = len(pickle.dumps(m))
    first = m.gradients(ids, target, np.ones(target.shape, bool))["key"]
    assert np.shares_memory(first, m.gradients(ids, target, np.ones(target.shape, bool))["key"])
    assert len(pickle.dumps(m)) == size


def test_gradients_with_large_logits():
    m, rng = model(6, 60.0), np.random.default_rng(9)
    ids, target = rng.integers(0, at.SYMBOLS, (4, at.SPAN)), rng.integers(0, at.SYMBOLS, (4, at.STRIDE))
    real = np.ones(target.shape, bool)
    got = {k: v.copy() for k, v in m.gradients(ids, target, real).items()}
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    for k, want in m.gradients(ids, target, real).items():
        assert np.isfinite(got[k]).all() and np.abs(got[k] - want).max() <= 1e-2 * np.abs(want).max() + 1e-6, k


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(lm, "CACHED_WORDS", 3)
    cut = lm.Subwords(lm.VOCABULARY)
    for words in (["the", "of"], ["the", "river", "opens"]):
        cut(pa.array(words, pa.large_string()))
    assert "the" in cut.known and "of" not in cut.known
