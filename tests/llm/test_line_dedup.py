import hashlib
import random
from collections import defaultdict

import pytest

from coexnet.llm import line_dedup

SCHEMA = "doc_id long, text string, doc string, n_dropped string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=40, min_docs=5):
    """Kept text and counts of every row; a null id is below all others."""
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key_of(x), ())) >= min_docs and max(holders[key_of(x)], key=order) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.apply_keep(df, line_dedup.dedup_lines(df, **kw))
    assert got.columns == ["doc_id", "text", "doc", "n_dropped", "n_lines", "kept_text"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("hot", [1024, 7])
def test_random_texts_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    rng = random.Random(3)
    pool = [f"{'Line' if k % 2 else 'zeile'} number {k} with enough characters to count" for k in range(30)] + ["short", "", "  "]
    rows = []
    for i in range(120):
        lines = [rng.choice(("", " ", "\t\x0b")) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(("", "\r", "  ")) for x in rng.choices(pool, k=rng.randrange(12))]
        rows.append((i, "\n".join(lines), "x", "y"))
    rows += [(200 + i, pool[0], None, None) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    assert run(spark, []) == []
    line, other = "q" * 40, "é" * 39
    rows = [(i, f"{line}\n\n{line}\n{other}", None, None) for i in (1, 2, 3, None, None)] + [(9, line, "", ""), (9, f"{line}\nmore", "", ""), (9, f"{line}\nmore", "", ""), (4, None, "", ""), (5, "", "", "")]
    assert run(spark, rows) == brute(rows)
    rows = [(i, other, "", "") for i in range(8)]  # 39 code points
    assert all(r[2] == 0 for r in run(spark, rows))
    rows = [(i, "x" * 100_000 + "\n" + "tail" * 12, "", "") for i in range(4)] + [(1, "tail" * 12, "", "")]
    assert all(r[2] == 0 for r in run(spark, rows))  # four documents only, one of them twice
    rows.append((77, "tail" * 12, "", ""))
    assert run(spark, rows) == brute(rows)


def test_bitmaps_are_runs_of_zeros(spark):
    dropped = spark.createDataFrame([(1, 5, p) for p in (0, 1, 2, 7, 9, 10)] + [(1, 6, 4), (1, 6, 4), (None, 5, 3)], "doc long, mark long, pos int")
    got = {(r["doc"], r["mark"]): (r["n_dropped"], [tuple(z) for z in r["zeros"]]) for r in line_dedup.keep_bitmaps(dropped).collect()}
    assert got == {(1, 5): (6, [(0, 3), (7, 1), (9, 2)]), (1, 6): (1, [(4, 1)]), (None, 5): (1, [(3, 1)])}


def test_hashes_are_range_partitioned_once_and_no_python_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = line_dedup.line_hashes(docs)
    plan = line_dedup.repeated_lines(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)}
    assert {tuple(r) for r in line_dedup.op12_line_dedup(spark, sf).collect()} == want
