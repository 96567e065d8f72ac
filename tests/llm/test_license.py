import itertools
import random

import numpy as np
import pytest

from coexnet.llm import license_scan as ls
from coexnet.llm.license_texts import TEXTS


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_longest_run():
    for p in itertools.permutations(range(6)):
        run = [p[i] for i in ls.longest_run(list(p))]
        best = max(len(c) for n in range(7) for c in itertools.combinations(p, n) if list(c) == sorted(c))
        assert run == sorted(run) and len(run) == best


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    b = rng.sample(range(100), 30)
    a = [x for x in b if rng.random() < 0.8]
    for _ in range(5):
        a.insert(rng.randrange(len(a)), rng.randrange(100, 200))
    pairs = ls.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert len(pairs) == longest_common(a, b)  # words are unique, so nothing is lost
    c = rng.choices(range(5), k=30)
    d = rng.choices(range(5), k=30)
    assert all(c[i] == d[j] for i, j in ls.patience(c, d)) and len(ls.patience(c, c)) == 30


GRANT = next(t for k, t in TEXTS if k == "MIT").replace("{", "").replace("}", "")
NEAR = {
    "licensed under the GNU General Public License, version 2": "GPL-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the BSD License.": "BSD", "Licensed under CC BY 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0!": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "released under the MIT budget": None, "Licensed under the Apache License, Version 1.1": "Apache-1.1", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT", "released under the terms of a licence": None, "Distributed under the BSD 3-Clause License": "BSD-3-Clause", "licensed under the GNU Lesser General Public License, version 3.0": "LGPL-3.0", "the MIT License": None,
}


def names(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in ls.scan_licenses(df, TEXTS).orderBy("doc_id", "first_word").collect():
        out[r["doc_id"]].append(r["license"])
    return out


def test_kin_are_told_apart(spark):
    assert names(spark, list(NEAR)) == [[v] if v else [] for v in NEAR.values()]
    every = ". ".join(k for k, v in NEAR.items() if v)
    assert names(spark, [every]) == [[v for v in NEAR.values() if v]]


def test_every_template_is_found_as_itself_wherever_it_lies(spark):
    bare = [(k, t.replace("{", "").replace("}", "")) for k, t in TEXTS]
    texts = ["pad " * (i % 67) + t + " tail" * (i % 5) for i, (_, t) in enumerate(bare)]
    got = names(spark, texts)
    assert got == [[k] for k, _ in bare]
    stretched = [" * ".join(t.split()) for t in texts]
    assert names(spark, stretched) == got
    assert names(spark, [f"{t} {t} {t}" for _, t in bare]) == [[k] * 3 for k, _ in bare]


def test_shifts_of_a_stretched_text(spark):
    text = "# * # ".join(f"{w} " for w in GRANT.split())
    assert names(spark, ["x " * n + text for n in range(0, 140, 7)]) == [["MIT"]] * 20


def test_scan_against_brute_force():
    """All places and all templates, aligned by a longest common subsequence of what is near the key."""
    rng = random.Random(4)
    ready = ls.Templates([("a", "one two {three four} five six seven"), ("b", "one {three} eight nine"), ("c", "{nine ten} two {five} one")], 0.8)
    code = {w: i for i, w in enumerate(ready.words.to_pylist())}
    for _ in range(300):
        words = [code.get(w, -1) for w in rng.choices([*code, "x", "y"], k=40)]
        for part in rng.sample(ready.rows, 2):
            at = rng.randrange(40)
            words[at:at] = [w for w in part if rng.random() < 0.95]
        got = ready.scan(np.array(words))
        spans = sorted((h[2], h[3]) for h in got)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        for t, row in enumerate(ready.rows):
            (a, b), *rest = ready.phrases[t]
            for i in range(len(words)):
                if words[i : i + b - a] != row[a:b]:
                    continue
                hit = ready.match(words, i, t)
                slack, own = max(4, len(row) // 4), set(row)
                left = [w for w in words[:i] if w in own][::-1][: a + slack] if a else []
                right = [w for w in words[i + b - a :] if w in own][: len(row) - b + slack] if b < len(row) else []
                most = b - a + longest_common(left, row[:a][::-1]) + longest_common(right, row[b:])
                exact = words[i - a : i - a + len(row)] == row and i >= a
                assert hit is None or hit[0] <= most
                assert not exact or hit and hit[0] == len(row)
                if exact:  # a whole text stands unless another find takes more words of it
                    assert any(h[0] == t and h[2] == i - a for h in got) or any(h[2] < i - a + len(row) and i - a < h[3] and h[1] >= len(row) for h in got)


def test_frame(spark):
    edited = GRANT.replace("free of charge", "at no charge").upper()
    rows = [(1, f"some text. {GRANT} more", "x"), (2, f"\n{edited}\n", "x"), (3, "the of and to in " * 500, "x"), (4, None, "x"), (None, "Released under the MIT License", "x"), (5, GRANT[: len(GRANT) // 2], "x"), (6, "pad " * 30_000 + "(Licensed under CC BY-NC 4.0) " * 2, "x"), (1, f"some text. {GRANT} more", "x"), (7, "", "x"), (8, "MIT License " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"], round(r["coverage"], 2)) for r in ls.scan_licenses(df, TEXTS).collect()), key=str)
    assert [x for x in got if x[0] == 1] == [(1, "MIT", 1.0)] * 2
    assert [x[:2] for x in got if x[0] == 2] == [(2, "MIT")] and [x for x in got if x[0] is None] == [(None, "MIT", 1.0)]
    assert {x[0] for x in got} == {1, 2, None, 6} and got.count((6, "CC-BY-NC-4.0", 1.0)) == 2
    assert ls.scan_licenses(df.limit(0), TEXTS).count() == 0 and ls.scan_licenses(df, [("e", " . ")]).count() == 0
    hit = ls.scan_licenses(df.where("doc_id = 1"), TEXTS).first()
    assert (hit["first_word"], hit["end_word"]) == (2, 2 + len(GRANT.split()))
