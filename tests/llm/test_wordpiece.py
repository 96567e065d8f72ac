import random

import pyarrow as pa
import pytest

from coexnet.llm import wordpiece as wp


def greedy(word, initial, inner):
    at = n = 0
    while at < len(word):
        pieces = inner if at else initial
        end = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), 0)
        if not end:
            return 0
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_automaton(seed):
    rng = random.Random(seed)
    make = lambda n: {"".join(rng.choices("abé", k=rng.randint(1, 5))) for _ in range(n)}
    initial, inner = make(rng.randint(0, 8)), make(rng.randint(0, 8))
    machine = wp.Automaton(sorted(initial), sorted(inner))
    words = ["".join(rng.choices("abé", k=rng.randint(1, 120 if seed % 4 == 0 else 12))) for _ in range(60)]
    want = [greedy(w, initial, inner) for w in words]
    assert machine.walk_all(pa.array(words, pa.large_string())).tolist() == want == [machine.walk(w) for w in words]


def test_frame(spark):
    df = spark.createDataFrame([(1, "ab abab q", "x"), (2, None, ""), (None, "", ""), (1, "ab abab q", "x"), (3, "ab" * 50_000, ""), (4, "\x0bab\tab\n", "")], "doc_id long, text string, n_words string")
    got = sorted((tuple(r) for r in wp.token_counts(df, ["ab"], ["ab"]).collect()), key=str)
    assert got == [(1, 3, 4, 1), (1, 3, 4, 1), (2, 0, 0, 0), (3, 1, 50_000, 0), (4, 2, 2, 0), (None, 0, 0, 0)]
    assert wp.token_counts(df.limit(0), ["ab"], []).count() == 0


def test_query_matches_greedy(spark, sf):
    initial, inner = (set(x) for x in wp.read_vocabulary(wp.VOCABULARY))
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    longest = max(map(len, initial | inner))

    def count(word):
        at = n = 0
        while at < len(word):
            pieces = inner if at else initial
            end = next((j for j in range(min(len(word), at + longest), at, -1) if word[at:j] in pieces), 0)
            if not end:
                return 1
            at, n = end, n + 1
        return n

    for r in wp.op8_token_counts(spark, sf).collect():
        if r["doc_id"] % 10 == 0:
            assert r["n_tokens"] == sum(map(count, (text[r["doc_id"]] or "").replace("\x0b", " ").split()))
