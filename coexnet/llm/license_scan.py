"""Licence texts in documents by patience alignment.

Words are compared in lower case without punctuation at their ends; words that are
nothing but punctuation don't count, and neither do words that the template
hasn't. Words that occur once on both sides are anchors; the longest run of anchors in
order on both sides is kept, and the gaps between them are aligned in the same way, as
are equal words next to them. Coverage is the share of the template's
words that are aligned.

A template marks the phrases that tell it from its kin (a name, a version, a clause)
with braces. They must stand in the text as they are, and be aligned; so
version 2 of a licence is never taken for version 3. Every place of a template's first such phrase
is looked at: what is before and after it is aligned with the
template's words before and after it, in as many of the template's words as it has, and
``slack`` (a quarter, 4 at least) more. There are no other windows, so where a text lies in a
document makes no difference.

Of overlapping finds the one with the most aligned words stands, then
the better covered, then the shorter one: a licence wins over another one whose clauses it holds.

Defined cases: null and empty texts match nothing; templates without words
are ignored, and one without a marked phrase is looked for by all its words;
rows are scanned one by one, so repeated rows repeat; an empty table gives no rows. Only id and text
are read; templates are a parameter, sent to all tasks, and meant to be a few hundred texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import split_words, table, text_slices
from coexnet.llm.license_texts import TEXTS

LEAST_COVERAGE = 0.8
MARKS = ".,;:!?\"'()[]{}<>*#/-_`|~=+"


def longest_run(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), in order."""
    pairs = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a: dict[int, int] = {}
        in_b: dict[int, int] = {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        both = sorted((i, in_b[w]) for w, i in in_a.items() if i >= 0 and in_b.get(w, -1) >= 0)
        run = [both[k] for k in longest_run([j for _, j in both])]
        if not run:
            continue
        pairs += run
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)], strict=True):
            if i1 > i0 + 1 and j1 > j0 + 1:
                todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(pairs)


class Templates:
    """(name, words, phrases) of texts with phrases in braces; a phrase is (first, last + 1), the first one is the key."""

    def __init__(self, texts: list[tuple[str, str]], least: float):
        self.names, spans, raw = [], [], []
        for name, text in texts:
            words, phrases, at = [], [], None
            for part in re.split(r"([{}])", text):
                if part == "{":
                    at = len(words)
                elif part == "}":
                    phrases.append((at, len(words)))
                else:
                    bare = (w.strip(MARKS) for w in re.findall(r"[^\x20\x09-\x0D]+", part))
                    words += [w.translate(_LOWER) for w in bare if w]
            if words:
                self.names.append(name)
                raw.append(words)
                spans.append(phrases or [(0, len(words))])
        known = sorted({w for words in raw for w in words})
        code = {w: i for i, w in enumerate(known)}
        self.words = pa.array(known, pa.large_string())
        self.rows, self.phrases = [[code[w] for w in words] for words in raw], spans
        self.sets = [frozenset(r) for r in self.rows]
        self.need = [max(1, int(np.ceil(least * len(r) - 1e-9))) for r in self.rows]
        self.keys: dict[int, dict[tuple[int, ...], list[int]]] = {}  # first word of a key -> key -> templates
        for t, (row, ((a, b), *_)) in enumerate(zip(self.rows, spans, strict=True)):
            self.keys.setdefault(row[a], {}).setdefault(tuple(row[a:b]), []).append(t)
        self.starts = np.isin(np.arange(len(known) + 1), list(self.keys))

    def match(self, words: list[int], at: int, t: int) -> tuple[int, int, int] | None:
        """(matched words, first, last + 1) of template t, whose key is at ``at`` in a text's word ids; None if it isn't there."""
        row, mine, (a, b), most = self.rows[t], self.sets[t], self.phrases[t][0], len(words)
        slack = max(4, len(row) // 4)

        def near(place: int, step: int, n: int) -> list[int]:
            out = []
            while n and 0 <= place < most:
                if words[place] in mine:
                    out.append(place)
                    n -= 1
                place += step
            return out

        before, after = near(at - 1, -1, a + slack if a else 0), near(at + b - a, 1, len(row) - b + slack if b < len(row) else 0)
        where = {a + i: at + i for i in range(b - a)}
        where |= {a - 1 - j: before[i] for i, j in patience([words[x] for x in before], row[:a][::-1])}
        where |= {b + j: after[i] for i, j in patience([words[x] for x in after], row[b:])}
        if len(where) < self.need[t]:
            return None
        for x, y in self.phrases[t][1:]:
            if any(where.get(j, -1) != where.get(x, -2) + j - x for j in range(x, y)):
                return None
        return len(where), min(where.values()), max(where.values()) + 1

    def scan(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first, last + 1) of a text's word ids (-1: in no template), without overlaps."""
        found = []
        ids = words.tolist()
        for at in np.flatnonzero(self.starts[words]):
            for key, templates in self.keys[ids[at]].items():
                if tuple(ids[at : at + len(key)]) == key:
                    found += [(t, *hit) for t in templates if (hit := self.match(ids, int(at), t))]
        found.sort(key=lambda h: (-h[1], -h[1] / len(self.rows[h[0]]), h[3] - h[2], h[2], self.names[h[0]]))
        firsts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []
        for hit in found:
            k = bisect_left(firsts, hit[2])
            if (k == 0 or kept[k - 1][3] <= hit[2]) and (k == len(firsts) or hit[3] <= firsts[k]):
                firsts.insert(k, hit[2])
                kept.insert(k, hit)
        return kept


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]], least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched, first_word, end_word): every stretch of a text that covers a template."""
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates, least))
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    schema = T.StructType([id_field, T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        known = sent.value
        for b in text_slices(batches, "text", 8 << 20):
            owner, codes, names = split_words(b.column("text"))
            bare = pc.utf8_trim(names, MARKS)
            place = pc.fill_null(pc.index_in(bare, value_set=known.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            real = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
            word = place[codes]
            start = np.searchsorted(owner, np.arange(b.num_rows + 1))
            ids, out = b.column("doc_id").to_pylist(), []
            for i in np.unique(owner[known.starts[word]]):  # texts with a word that begins a key
                at = np.flatnonzero(real[codes[start[i] : start[i + 1]]])  # words with more than punctuation
                for t, n, first, end in known.scan(word[start[i] : start[i + 1]][at]):
                    out.append((ids[i], known.names[t], n / len(known.rows[t]), n, int(at[first]), int(at[end - 1]) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, types, strict=True)], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"), TEXTS)
