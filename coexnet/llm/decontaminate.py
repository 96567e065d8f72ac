"""Benchmark passages in documents, found by the q-gram lemma.

An item of ``m`` characters that occurs in a text with at most ``k`` edits
(``k = floor(edit_rate * m)``) keeps at least ``m - q + 1 - k * q`` of its
q-grams (``q = min(Q, m // (k + 1))``, so that this is 1 or more), and all of them lie on diagonals (text position minus item position)
within ``k`` of the occurrence's start. So shared q-grams are counted per item
in diagonal bands of ``2 * (2k + 1)`` that overlap by half; every occurrence
lies wholly in one band. Bands that reach the bound are verified by a banded
alignment with free ends in the text, and those within ``k`` edits are
matches. The filter loses nothing: a match is reported if and only if the
alignment finds one.

Texts and items are compared with A-Z and the capital letters of Latin-1 in lower
case and runs of white space as one blank (ends trimmed for items); spans
count the code points of the original text.

Items are held in blocks of about ``block_chars`` characters, so what is sent to the
tasks is bounded however many items there are; each block takes a pass over
the documents. A document's whole text is searched; nothing is grouped, so
there is no skew to speak of.

Defined cases: null and blank items match nothing; null text matches nothing; rows are treated
one by one, so repeated rows repeat; equal items each report; null item ids
are reported as null; empty tables give no rows. Only the named columns are
read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import table, text_slices

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 4 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xBF58476D1CE4E5B9)


def normal_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their positions in the text) with case and white space levelled."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (c >= 65) & (c <= 90) | (c >= 192) & (c <= 222) & (c != 215)
    c = np.where(upper, c + 32, c)
    space = (c == 32) | (c >= 9) & (c <= 13) | (c == 160)
    c = np.where(space, 32, c)
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return c[at], at


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams of ``c``."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _MULT + c[i : i + n]
    h ^= h >> np.uint64(31)
    return h * _FOLD


def exact(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """What ``align`` returns, if the item occurs without an edit."""
    raw, part = text.tobytes(), item.tobytes()
    at = raw.find(part)
    while at % text.itemsize and at >= 0:
        at = raw.find(part, at + 1)
    return (0, at // text.itemsize, at // text.itemsize + len(item)) if at >= 0 else None


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``text`` with free ends, None if over ``k`` edits.

    ``text`` is a window about as long as the item, so the band is the window's slack.
    """
    m, n = len(item), len(text)
    cols = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int32), cols.copy()
    slack = n - m + k + 1
    for i in range(1, m + 1):
        lo, hi = max(0, i - k - 1), min(n, i + slack)
        across = np.empty(n + 1, np.int32)
        across[1:] = cost[:-1] + (text != item[i - 1])
        across[0] = 1 << 20
        down = cost + 1
        new = np.minimum(across, down)
        begin = np.where(across <= down, np.concatenate([start[:1], start[:-1]]), start)
        new[:lo], new[hi + 1 :] = 1 << 20, 1 << 20
        level = new - cols
        best = np.minimum.accumulate(level)
        first = np.maximum.accumulate(np.where(level == best, cols, 0))
        cost, start = (best + cols).astype(np.int32), begin[first]
        if cost.min() > k:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= k else None


class ItemIndex:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.ids, self.chars, self.q, self.k, self.need = [], [], [], [], []
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            c, _ = normal_form(text)
            c = c[1:] if len(c) and c[0] == 32 else c
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if not len(c):
                continue
            k = int(edit_rate * len(c))
            g = max(1, min(q, len(c) // (k + 1)))
            parts.setdefault(g, []).append((grams(c, g), len(self.ids)))
            self.ids.append(item_id)
            self.chars.append(c)
            self.q.append(g)
            self.k.append(k)
            self.need.append(len(c) - g + 1 - k * g)
        self.k_of, self.need_of = np.array(self.k, np.int64), np.array(self.need, np.int64)
        self.tables = []
        for g, xs in parts.items():
            h = np.concatenate([x for x, _ in xs])
            item = np.concatenate([np.full(len(x), i, np.int32) for x, i in xs])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in xs])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            hot = np.zeros(1 << 22, bool)
            hot[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((g, hot, keys, first, count, item[order], at[order]))

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, start, end, edits) of all items in the text, the best occurrence of each band."""
        c, place = normal_form(text)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for g, hot, keys, first, count, item, at in self.tables:
            h = grams(c, g)
            pos = np.flatnonzero(hot[(h >> np.uint64(42)).astype(np.int64)])
            if not len(pos):
                continue
            key = np.searchsorted(keys, h[pos])
            key[key == len(keys)] = 0
            same = keys[key] == h[pos]
            pos, key = pos[same], key[same]
            n = count[key]
            total = int(n.sum())
            if not total:
                continue
            entry = np.repeat(first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            which, i_at = item[entry].astype(np.int64), at[entry]
            enough = np.bincount(which, minlength=len(self.ids)) >= self.need_of  # no band holds more than all
            some = enough[which]
            which, i_at, diag = which[some], i_at[some].astype(np.int64), (np.repeat(pos, n) - i_at)[some]
            if not len(which):
                continue
            width = 2 * self.k_of[which] + 1
            band = (diag + len(c) + width) // width  # both bands that hold the diagonal: this and the one before
            span = np.int64(2 * len(c) + 64)
            bands, hits = np.unique(np.concatenate([which * span + band, which * span + band - 1]), return_counts=True)
            full = bands[hits >= self.need_of[bands // span]]
            if not len(full):
                continue
            # the lemma speaks of the item's q-grams: one that is met twice in a band counts once
            both = np.concatenate([which * span + band, which * span + band - 1])
            which2 = np.searchsorted(full, both)
            which2[which2 == len(full)] = 0
            inside = full[which2] == both
            longest = np.int64(max(map(len, self.chars)))
            once = np.unique(which2[inside] * longest + np.concatenate([i_at, i_at])[inside])
            hits = np.bincount(once // longest, minlength=len(full))
            code = full
            for x in code[hits >= self.need_of[code // span]]:
                i, b = int(x // span), int(x % span)
                m, k = len(self.chars[i]), self.k[i]
                w = 2 * k + 1
                low = b * w - len(c) - w
                lo, hi = max(0, low - k), min(len(c), low + 2 * w + m + k)
                if hi <= lo:
                    continue
                found = exact(self.chars[i], c[lo:hi]) or align(self.chars[i], c[lo:hi], k)
                if found and (i, lo + found[2]) not in out or found and found[0] < out[i, lo + found[2]][0]:
                    out[i, lo + found[2]] = (found[0], lo + found[1])
        hits = []
        for (i, end), (edits, start) in sorted(out.items()):
            hits.append((self.ids[i], int(place[start]) if start < len(place) else len(text), int(place[end - 1]) + 1, edits))
        return hits


_built: dict[str, ItemIndex] = {}


def _index(block: tuple) -> ItemIndex:
    """The index of a block of items (token, items, q, edit rate), built once in each Python process, which holds one at a time."""
    token, *rest = block
    if token not in _built:
        _built.clear()
        _built[token] = ItemIndex(*rest)
    return _built[token]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The items in lists of about ``block_chars`` characters each (one long item may exceed it)."""
    named = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = named.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars)
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in named.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).collect()]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every match of an item in a document."""
    spark = docs.sparkSession
    item_field = T.StructField("item_id", items.schema[item_id_col].dataType)
    doc_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    schema = T.StructType([doc_field, item_field, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_id_col, item_text_col, block_chars):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block, q, edit_rate))

        def search(batches, sent=sent):
            index = _index(sent.value)
            for b in text_slices(batches, "text"):
                ids, found = b.column(0).to_pylist(), []
                for i, text in enumerate(b.column(1)):
                    t = text.as_py()
                    if t:
                        found += [(ids[i], *hit) for hit in index.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((),) * 5, types, strict=True)], names=schema.names)

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (all columns) without the rows whose text holds an item; each row is judged by its own text.

    The pass filters where the text lies, so no text is shuffled.
    """
    for block in _blocks(items, item_id_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, q, edit_rate))

        def clean(batches, sent=sent):
            index = _index(sent.value)
            for b in text_slices(batches, text_col):
                texts = (t.as_py() for t in b.column(b.schema.get_field_index(text_col)))
                yield b.filter(pa.array([not t or not index.find(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages in all documents: a row per document and item, with its best occurrence."""
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.min(F.struct("edits", "start", "end")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_found")).select("doc_id", "item_id", "b.start", "b.end", "b.edits", "n_found")
