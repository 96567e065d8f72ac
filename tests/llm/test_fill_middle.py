import hashlib
import random
import re

import pytest

from coexnet.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, output int"


def brute(i, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return i, len(units), "plain", None, None, text, text
    if h4 % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def run(spark, rows, **kw):
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in got), key=str)


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_random_texts_against_brute_force(spark, fim, spm):
    rng = random.Random(5)
    bits = ["a", "\n", "é", "𝔘", "<", "P>", "S>", "M>", "<S", "word ", "\r\n", "\x00", " ", "'"]
    rows = [(rng.randrange(-50, 10**12), "".join(rng.choices(bits, k=rng.randrange(40))), None, None) for _ in range(400)]
    want = sorted((brute(i, t, fim, spm) for i, t, *_ in rows), key=str)
    assert run(spark, rows, fim_percent=fim, spm_percent=spm) == want


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, None), (None, "a\nb", "", 1), (1, "", "", 1), (2, "\n" * 1000, "", 1), (3, "x" * 3_000_000, "", 1), (3, "x" * 3_000_000, "", 1), (4, "one <M> line\nmore", "", 1), (5, "end <", "", 1)]
    assert run(spark, rows, slice_bytes=1000) == sorted((brute(i, t) for i, t, *_ in rows), key=str)
    with pytest.raises(ValueError, match="different"):
        fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), marks=("<P>", "<P>", "<M>"))


def test_other_ids_and_marks(spark):
    df = spark.createDataFrame([("a'b", "x\ny\nz")], "key string, body string")
    (r,) = fill_middle.fill_in_middle(df, "key", "body", marks=("<'p'>", "<suf>", "<m>")).collect()
    assert r["restored"] == "x\ny\nz" and r["output"].count("<suf>") == 1 and r["doc_id"] == "a'b"


def test_query(spark, sf):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(*w[:5], sha(w[5]), sha(w[6])) for w in (brute(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())}
    got = fill_middle.op13_fill_in_middle(spark, sf)
    assert {tuple(r) for r in got.collect()} == want and {w[2] for w in want} >= {"psm", "spm"}
