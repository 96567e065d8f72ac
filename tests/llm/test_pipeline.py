import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from coexnet.llm.common import save
from coexnet.llm.quality import features
from tests.llm.test_mix import brute_targets


def text(seed, n=60):
    words = "alpha beta gamma delta omega river stone light cloud paper glass north winter garden".split()
    return " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + str((seed * 31 + i) % 97) for i in range(n)) + "."


def test_stages(spark, tmp_path):
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(30)]
    item = "the benchmark item that must never be part of a training corpus, whatever happens to it"
    rows += [(100, text(3), "en", "s0", 1), (101, text(4) + " extra", "en", "s1", 1), (102, text(90) + "\n" + item + "\n" + text(91), "en", "s1", 1), (104, None, None, None, None), (105, "", "en", "s2", 0)]
    junk = [(300 + i, f"SPAM{i}!! BUY!! NOW!! " * (30 + i), "en", "s2", 1) for i in range(20)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(300 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionAll(spark.createDataFrame(junk, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "source_mix"]
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["quality"](spark, docs, str(tmp_path)).collect()}
    assert not kept & {r[0] for r in junk} and kept >= set(range(25))
    docs = save(docs.where("doc_id is null or doc_id < 300"), "t")
    near = save(stages["near_duplicates"](spark, docs, str(tmp_path)), "t")
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {r[0] for r in rows} - {100, 101}
    clean = stages["decontamination"](spark, near, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {100, 101, 102}
    mixed = stages["source_mix"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in mixed.collect()} == {r[0] for r in rows} and mixed.where(F.col("taken") > 2 * F.col("size")).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= kept - {100, 101, 102}


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def edits(item, t):
    """Least edits of the item at any place of the text."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on rows with nulls, copies, repeated rows, clashing names, by its rule written out."""
    rng = random.Random(2)
    item = "what is the tallest mountain on the northern side of the valley"
    texts = [text(i, 30 + i) for i in range(24)]
    texts += [texts[2] + " one", texts[3], " ".join(texts[5].split()[1:]), texts[7] + " " + item, item[:20] + "x" + item[21:], item[:30] + texts[9], None, "", "  ", "two words", "BUY!!! NOW### " * 30, "$$$ " * 50]
    rows = [(i, t, None if i % 7 == 0 else "en", rng.choice(["a", "b", None]), None if t is None else len(t), 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[6], "en", "a", 1, 0.5, "x"), (None, text(77), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __quality double, __id string")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)

    model = corpus_pipeline.classifier(spark, d)
    got = stages["quality"](spark, docs, d)
    assert got.columns == docs.columns
    scores = [float(model.score(features(pa.array([r[1]], pa.string())))[0]) for r in rows]
    assert key(got.collect()) == key(r for r, s in zip(rows, scores, strict=True) if s >= 0.5)

    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:  # the least position spreads along links
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((root[i], None) if sets[i] else (root[i], i), []).append(r)
    near = save(stages["near_duplicates"](spark, docs, d), "t")
    assert near.columns == docs.columns
    ids = lambda rows: sorted((r[0] for r in rows), key=repr)
    assert ids(near.collect()) == ids(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())

    clean = stages["decontamination"](spark, docs, d)
    level = lambda t: re.sub(r"\s+", " ", (t or "").lower())
    assert clean.columns == docs.columns and key(clean.collect()) == key(r for r in rows if not r[1] or edits(level(item), level(r[1])) > len(item) // 10)

    mixed = stages["source_mix"](spark, docs, d).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in mixed) == sorted(size(r[1]) for r in rows)
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in ("a", "b", None)}
    want = brute_targets(total)
    largest = max(size(r[1]) for r in rows)
    for s in total:
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in mixed if r["source"] == s)
        assert abs(sum(r["taken"] for r in mixed if r["source"] == s) - want[s]) <= largest
