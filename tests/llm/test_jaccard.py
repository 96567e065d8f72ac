import random
import re

import numpy as np
import pyarrow as pa
import pytest

from coexnet.llm import jaccard
from coexnet.llm.graph import connected_components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    s = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(top(i), []).append(d)
    least = lambda g: min((d for d in g if d is not None), default=None)
    return sorted(((d, len(s[i]), least(groups[top(i)])) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs, passage = [], " ".join(rng.choices(vocabulary, k=30))
    for i in range(n_docs):
        kind = rng.random()
        if docs and kind < 0.5:
            w = (rng.choice(docs)[1] or "x").split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind < 0.7:
            text = passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))
        docs.append((i, text))
    return docs


@pytest.mark.parametrize(("seed", "n", "percent", "chunk"), [(1, 3, 90, 4096), (2, 5, 80, 4096), (3, 3, 90, 8)])
def test_components(spark, seed, n, percent, chunk):
    docs = corpus(seed)
    docs += [(500, None), (501, ""), (502, " \t"), (503, "One two"), (504, "one TWO"), (505, "two one"), (7, docs[7][1]), (None, docs[9][1]), (506, "long " * 5000), (507, "long " * 4999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, percent, chunk=chunk).collect()]
    assert sorted(got, key=str) == brute(docs, n, percent)


def test_keep_one(spark):
    docs = corpus(5, 80)
    docs += [(200, None), (201, ""), (202, None), (3, docs[3][1]), (None, "an orphan without any id at all here"), (None, "and another orphan without any id there")]
    df = spark.createDataFrame([(d, t, "keep") for d, t in docs], "doc_id long, text string, node string")
    kept = jaccard.keep_one(df).collect()
    want = {c for _, n, c in brute(docs, 5, 80) if n and c is not None}
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert sorted(r["doc_id"] for r in kept if r["text"] and r["doc_id"] is not None) == sorted(want)
    assert sorted(r["doc_id"] for r in kept if not r["text"]) == [200, 201, 202] and all(r["node"] == "keep" for r in kept)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).count() == 0 and jaccard.keep_one(df).count() == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 300), dtype=np.uint64))
            drop = rng.integers(0, 1 + len(a) // 8)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, 1 + len(a) // 8), dtype=np.uint64)]))
            if not len(b):
                continue
            a_, b_ = sorted((a, b), key=len)
            overlap = len(np.intersect1d(a, b))
            if 100 * overlap >= percent * (len(a) + len(b) - overlap):
                found = jaccard.sketch_forest(np.array([len(a_), len(b_)]), [jaccard.parity_sketch(x, percent) for x in (a_, b_)], percent)
                assert found and jaccard.link_forest([a_, b_], percent)


def test_ngram_sets_of_sliced_arrays():
    texts = pa.array(["zz", "a b c d", None, "A  b\nc d", ""], pa.large_string())
    s = jaccard.ngram_sets(texts.slice(1), 3)
    assert [len(x) for x in s] == [2, 0, 2, 0] and (s[0] == s[2]).all()


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root.get(a, {a}), root.get(b, {b})
            both = ra | rb
            for x in both:
                root[x] = both
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == {k: min(v) for k, v in root.items()}
    assert connected_components(df.limit(0)).count() == 0


def test_small_parts_give_the_same_groups(spark, monkeypatch):
    """Blocks cut by members and by elements, postings by the weight of their sketches, against the uncut run."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 190 + rng.randrange(10)] + [f"own{i}"])) for i in range(60)] + [(100 + i, f"a b c d{i // 3} e f g") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.jaccard_components(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(jaccard, "CHUNK_ELEMENTS", 2000)
    monkeypatch.setattr(jaccard, "SKETCH_ELEMENTS", 50)
    monkeypatch.setattr(jaccard, "SEEN_NODES", 5)
    assert sorted(map(tuple, jaccard.jaccard_components(df, 3, 90, chunk=16).select("doc_id", "n_shingles", "component_id").collect())) == whole
    assert len({c for i, _, c in whole if i < 60}) < 5


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (3, "x y z", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __tie int, __text_tie int")
    assert sorted(map(tuple, jaccard.keep_one(df).collect())) == [rows[0], rows[2]]
