import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from coexnet.llm import collocations

SCHEMA = "text string, lang string, rank string, n int"


def grams(rows, most=4):
    """Counts of all phrases and words of each language."""
    counts, words = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, min(most, len(ws) - i) + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    return counts, words


def brute(rows, least=30, top=2000, percent=80):
    counts, words = grams(rows)
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for b in range(len(p) - m + 1):
                    longest[p[b : b + m]] = max(longest[p[b : b + m]], a)
        kept = []
        for p, a in cand.items():
            if p in longest and 100 * longest[p] >= percent * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def texts(rng, n, pool, hot=()):
    rows = []
    for i in range(n):
        ws = rng.choices(pool, k=rng.randrange(60))
        for _ in range(len(ws) // 8):
            at = rng.randrange(len(ws))
            ws[at:at] = rng.choice(hot).split(" ") if hot else []
        text = "".join(w + rng.choice((" ", " ", "  ", "\t", ", ", ".", "\n", " ")) for w in ws)
        rows.append((text, rng.choice(("en", "en", "en", "de", None, "und")), None, 0))
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_random_texts_against_brute_force(spark, monkeypatch, ranges):
    rng = random.Random(ranges)
    pool = ["the"] * 8 + ["A", "b", "ü", "𝔘x", "\x01", "a\x01", "\x00", "of", "c\x1f", "-", "É"] + [f"w{i}" for i in range(12)]
    rows = texts(rng, 150, pool, ("one two three four", "one two", "x y z", "the The the the the"))
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, f=collocations.phrase_counts: f(*a, ranges=ranges))
    assert run(spark, rows, min_count=5) == brute(rows, 5)
    assert run(spark, rows, min_count=5, top=3, subsumed_percent=50) == brute(rows, 5, 3, 50)


def test_counts_of_all_phrases(spark):
    rows = texts(random.Random(9), 40, ["a", "b", "c d", "\x05"]) + [("a a a a a a a a", "x\ty\n", "", 1)]
    got = {(r["key"], r["words"]): r["n"] for r in collocations.phrase_counts(spark.createDataFrame(rows, SCHEMA), min_count=1, ranges=7).collect()}
    counts, words = grams(rows)
    code = lambda s: "".join(dict(collocations.ESCAPED).get(c, c) for c in s)
    want = {("\t".join(map(code, (lang, *p))), len(p)): n for lang, f in counts.items() for p, n in f.items()}
    assert got == want | {(code(lang), 0): n for lang, n in words.items() if n}


def test_stack_joins_runs_over_batches_and_ranges():
    keys = ["l\tb", "l\ta\tc", "l\ta\tb\tb", "l\ta\tb\tb", "l\ta\tb", "l\ta", "l\ta"]
    whole = Counter()
    for cut in range(len(keys) + 1):
        for size in (1, 2, 9):
            got = Counter()
            batches = [pa.record_batch([pa.array([int(j >= cut)], pa.int32()), pa.array([k]), pa.array([2])], names=["part", "key", "n"]) for j, k in enumerate(keys)]
            table = pa.Table.from_batches(batches).combine_chunks()
            for b in collocations._count(3, 1)(table.to_batches(max_chunksize=size)):
                for k, d, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got[k, d] += n
            whole = whole or got
            assert got == whole == {("l\tb", 1): 2, ("l\ta", 1): 12, ("l\ta\tc", 2): 2, ("l\ta\tb", 2): 6, ("l\ta\tb\tb", 3): 4, ("l", 0): 14}


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, "en", "", 1), ("", None, "", 1), (" ,.\n\t", "en", "", 1), ("one", "en", "", 1)]) == []
    long = "q" * 200_000
    rows = [(f"{long} tail", "en", "", 1)] * 31 + [("x " * 100, None, "", 1), ("x x", "", "", 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [("a b", "en", "", 1)] * 29) == []


def test_large_numbers_stay_exact(spark):
    n = 9 * 10**17
    rows = [("l\ta", 1, n + 1), ("l\tb", 1, n), ("l\ta\tb", 2, n - 1)]
    (r,) = collocations.phrase_scores(spark.createDataFrame(rows, "key string, words int, n long")).collect()
    assert (r["score"], r["l"], r["r"]) == (2000000 * (n - 1) // (2 * n + 1), n + 1, n)


def test_query(spark, sf):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in collocations.op11_collocations(spark, sf).collect()) == brute(rows)
