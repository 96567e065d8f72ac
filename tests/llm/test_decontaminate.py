import random

import pytest

from coexnet.llm import decontaminate as dc


def edit_distance(item, text):
    """Fewest edits of item in any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def level(text):
    return "".join(map(chr, dc.normal_form(text)[0])).strip(" ")


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(6)]
    index = dc.ItemIndex(items)
    for _ in range(25):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            s = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + len(s) // 8)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "Y"])
            parts += ["".join(s), " ".join(word() for _ in range(rng.randint(0, 9)))]
        text = rng.choice([" ", "\n  ", ""]).join(parts)
        found = {i for i, *_ in index.find(text)}
        want = {index.ids[j] for j in range(len(index.ids)) if edit_distance(level(items[index.ids[j]][1]), "".join(map(chr, dc.normal_form(text)[0]))) <= index.k[j]}
        assert found == want
        for _, start, end, edits in index.find(text):
            assert 0 <= start < end <= len(text) and edits >= 0


ITEM = "The quick brown fox jumps over the lazy dog while nobody is looking at it at all."


def docs(spark):
    rows = [(1, f"intro {ITEM} outro", "x"), (2, "nothing here", "x"), (3, None, "x"), (4, "", "x"), (None, ITEM.upper().replace(" ", "  "), "x"), (1, f"intro {ITEM} outro", "x"), (5, "word " * 50_000 + ITEM.replace("fox", "fix") + " word" * 50_000, "x"), (6, ITEM[:40], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string")


def items(spark):
    return spark.createDataFrame([(10, ITEM), (11, None), (12, "   "), (None, "zzz qqq zzz")], "item_id long, text string")


def test_find_and_drop(spark):
    for block in (1 << 20, 5):
        found = sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in dc.find_items(docs(spark), items(spark), block_chars=block).collect())
        assert found == [(0, 10, 0), (1, 10, 0), (1, 10, 0), (5, 10, 1)]
        kept = dc.drop_contaminated(docs(spark), items(spark), block_chars=block).collect()
        assert sorted(r["doc_id"] for r in kept) == [2, 3, 4, 6]
    hit = dc.find_items(docs(spark), items(spark)).where("doc_id = 1").first()
    assert f"intro {ITEM} outro"[hit["start"] : hit["end"]] == ITEM


def test_empty(spark):
    assert dc.find_items(docs(spark).limit(0), items(spark)).count() == 0
    assert dc.find_items(docs(spark), items(spark).limit(0)).count() == 0
    assert dc.drop_contaminated(docs(spark), items(spark).limit(0)).count() == 8
    assert dc.ItemIndex([(1, "ab")]).find("xx AB yy") == [(1, 3, 5, 0)]


def test_short_items_keep_their_edits():
    for m in range(10, 45):
        item = "".join(chr(ord("a") + (i * i * 7 + i * 3 + i // 5) % 26) for i in range(m))
        k = m // 10
        near = list(item)
        for e in range(k):
            near[(e + 1) * m // (k + 1)] = "#"
        hits = dc.ItemIndex([(1, item)]).find("%% " + "".join(near) + " %%")
        assert [h[0] for h in hits] and min(h[3] for h in hits) <= k, m


def test_very_long_texts_go_in_slices(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(i, "filler words here " * 60_000 + (item if i % 2 else "")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.find_items(docs, items).collect()) == list(range(1, 20, 2))
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(docs, items).collect()) == list(range(0, 20, 2))
