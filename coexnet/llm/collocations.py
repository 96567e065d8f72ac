r"""Phrases of words that stay together, counted with Suffix-sigma.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those at blanks and tabs into words. For every word
a suffix of its piece, cut to ``max_words`` words, is shuffled; equal ones of a slice of texts are added up before. The
shuffle's key is the language and the suffix in order of its words, so that a language and first word stay together, but for
those that are more than a task's share: bounds from a sample of texts cut them further, at any depth. A task sorts its
suffixes in reverse order and counts all prefixes with one stack; what is open where a range begins or ends is a part,
added up with its neighbours' afterwards. The sample decides who counts what, never what is counted.

Scores come from joins of the frequent phrases with the counts of their two parts; a part that very many phrases share is
spread over tasks. All arithmetic is in whole numbers.

Defined cases: null texts are empty; a null language is ``und``; an empty table or one without a phrase of enough occurrences
gives no rows; repeated rows count as often as they are there. Only the named columns are read, so further columns (whatever
their names) don't matter. A text is never split over slices, and pieces never meet across texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coexnet.llm.common import attach, map_bytes, save, table, text_slices
from coexnet.llm.mix import running_sums

MAX_WORDS, MIN_COUNT, TOP, SUBSUMED_PERCENT = 4, 30, 2000, 80
SLICE_BYTES = 2 << 20
RANGE_ROWS, MOST_RANGES = 1 << 20, 1 << 14
SAMPLE_TEXTS, KEYS_PER_RANGE = 4096, 64
OUT_ROWS = 1 << 16

#: Keys are language and words joined by tabs. Bytes up to the tab's, and the line feed that marks this, are written as two higher ones, so that the order of keys is that of their words.
ESCAPED = [(chr(b), "\n" + chr(0x10 + b)) for b in (10, *range(10))]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_CUT[[*b".,;:!?", *range(10, 14)]] = True


def _escape(words: pa.Array) -> pa.Array:
    if pc.any(pc.match_substring_regex(words, r"[\x00-\x0A]")).as_py():
        for plain, coded in ESCAPED:
            words = pc.replace_substring(words, plain, coded)
    return words


def _unescape(key: Column) -> Column:
    out = key
    for plain, coded in reversed(ESCAPED):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.when(F.contains(key, F.lit("\n")), out).otherwise(key)


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rank of each value among the distinct ones, these in order)."""
    coded = pc.dictionary_encode(values)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()] if len(order) else np.zeros(len(values), np.int64), coded.dictionary.take(pa.array(order))


def _ahead(values: np.ndarray, d: int) -> np.ndarray:
    """The values ``d`` places ahead, zeros past the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - d)] = values[d:]
    return out


def words_in_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each word, the words, whether the next one is in the same piece) of texts without nulls."""
    low = map_bytes(texts.cast(pa.large_string()), _LOWER)
    _, offsets, data = low.buffers()
    at = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
    if len(low) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, bool)
    raw = np.frombuffer(data, np.uint8)[: at[-1]]
    cut = _CUT[raw]
    word = ~(cut | _BLANK[raw])
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    first[begin] = word[begin]  # words end where texts do
    last[end] = word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(at, starts, "right") - 1
    place = np.cumsum(cut, dtype=np.int64)[starts]
    together = np.zeros(len(starts), bool)
    together[:-1] = (place[1:] == place[:-1]) & (owner[1:] == owner[:-1])
    if len(starts) == 0:
        return owner, pa.array([], pa.large_string()), together
    edges = np.stack([starts, ends], 1).ravel()  # words and the gaps between them, in turn
    both = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), data])
    coded = pc.dictionary_encode(both)
    return owner, pa.DictionaryArray.from_arrays(pa.array(coded.indices.to_numpy()[::2]), coded.dictionary), together


def suffix_counts(texts: pa.Array, langs: pa.Array, max_words: int = MAX_WORDS) -> tuple[pa.Array, np.ndarray]:
    """(keys in order, how often each occurs) of the suffixes of all words of a slice."""
    owner, words, together = words_in_pieces(pc.fill_null(texts, ""))
    if len(owner) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    used, codes = np.unique(words.indices.to_numpy(), return_inverse=True)
    rank, names = _ranked(_escape(words.dictionary.take(pa.array(used))))
    codes = rank[codes]
    lang_rank, lang_names = _ranked(_escape(pc.fill_null(langs, "und").cast(pa.large_string())))
    key = lang_rank[owner]
    columns, going, width = [], np.ones(len(codes), bool), len(names) + 1
    for d in range(max_words):  # the rank of a suffix among those of d + 1 words
        if d:
            going = going & _ahead(together, d - 1)
        here = np.where(going, _ahead(codes, d), -1)
        columns.append(here)
        key = key * width + here + 1
        if d < max_words - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, where, n = np.unique(key, return_index=True, return_counts=True)
    parts = [lang_names.take(pa.array(lang_rank[owner[where]]))]
    for here in columns:
        c = here[where]
        parts.append(names.take(pa.array(c, mask=c < 0)))
    return pc.binary_join_element_wise(*parts, pa.scalar("\t", pa.large_string()), null_handling="skip"), n


def _places(keys: pa.Array, bounds: list[str]) -> np.ndarray:
    """The range of each of the ordered keys: how many bounds are below or equal."""
    if len(keys) < len(bounds):
        return np.fromiter((bisect_right(bounds, k) for k in keys.to_pylist()), np.int32, len(keys))
    cuts = []
    for b in bounds:
        low, high = cuts[-1] if cuts else 0, len(keys)
        while low < high:
            mid = (low + high) // 2
            if keys[mid].as_py() < b:
                low = mid + 1
            else:
                high = mid
        cuts.append(low)
    return np.repeat(np.arange(len(bounds) + 1, dtype=np.int32), np.diff([0, *cuts, len(keys)]))


def _emit(max_words: int, slice_bytes: int, bounds: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text", slice_bytes):
            keys, n = suffix_counts(piece.column("text"), piece.column("lang"), max_words)
            place = _places(keys, bounds)
            for i in range(0, len(n), OUT_ROWS):
                part = keys[i : i + OUT_ROWS].cast(pa.string())
                yield pa.record_batch([pa.array(place[i : i + OUT_ROWS]), part, pa.array(n[i : i + OUT_ROWS])], names=["part", "key", "n"])

    return work


def suffixes(docs: DataFrame, max_words: int = MAX_WORDS, bounds: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(part, key, n): suffixes of ``docs`` (text, lang) with the range that each falls into."""
    return docs.mapInArrow(_emit(max_words, slice_bytes, bounds or []), "part int, key string, n long")


def range_bounds(docs: DataFrame, ranges: int, max_words: int = MAX_WORDS) -> list[str]:
    """At most ``ranges - 1`` keys that cut the suffixes into about equal ranges, from those of a sample of texts (all, if few)."""
    rows = docs.count()
    want = max(SAMPLE_TEXTS, 4 * ranges)
    some = docs if rows <= want else docs.sample(want / rows, seed=1)
    keys = suffixes(some, max_words).select("key").distinct().orderBy(F.xxhash64("key")).limit(KEYS_PER_RANGE * ranges)
    found = sorted(r["key"].encode() for r in keys.collect())  # Python orders str by code point, as UTF-8 does
    step = len(found) / ranges
    return sorted({found[int(step * i)].decode() for i in range(1, ranges) if int(step * i) < len(found)})


class _Stack:
    """The open prefix at each depth, with its count, while keys come in reverse order."""

    def __init__(self, max_words: int, min_count: int):
        self.depths, self.least = max_words, min_count
        self.part, self.fresh, self.open = None, True, [None] * (max_words + 1)  # a depth's entry: [words, count, is a part]
        self.keys: list[str] = []
        self.words: list[int] = []
        self.n: list[int] = []
        self.totals: dict[str, int] = {}

    def close(self, depth: int, part: bool = False) -> None:
        entry, self.open[depth] = self.open[depth], None
        if entry and (part or entry[2] or entry[1] >= self.least):
            self.add(["\t".join(entry[0])], depth, [entry[1]])

    def add(self, keys: list[str], depth: int, counts: list[int]) -> None:
        self.keys += keys
        self.words += [depth] * len(keys)
        self.n += counts

    def finish(self) -> None:
        for depth in range(1, self.depths + 1):
            self.close(depth, True)

    def push(self, parts: pa.Array, n: np.ndarray) -> None:
        """Rows of one range, as lists of language and words."""
        at = parts.offsets.to_numpy()
        length, begin = np.diff(at), at[:-1] - at[0]
        coded = pc.dictionary_encode(parts.flatten())
        flat = coded.indices.to_numpy()
        grid = np.full((len(n), self.depths + 1), -1, np.int64)
        for d in range(self.depths + 1):
            has = length > d
            grid[has, d] = flat[begin[has] + d]
        same = np.logical_and.accumulate(grid[1:] == grid[:-1], axis=1)
        names = coded.dictionary
        for code in np.unique(grid[:, 0]):
            lang = names[int(code)].as_py()
            self.totals[lang] = self.totals.get(lang, 0) + int(n[grid[:, 0] == code].sum())
        head = parts[0].as_py()
        for d in range(self.depths, 0, -1):
            starts = np.append(0, np.flatnonzero(~same[:, d]) + 1)
            sums = np.add.reduceat(n, starts)
            live = grid[starts, d] >= 0
            before = self.open[d]
            if before and head[: d + 1] == before[0]:
                before[1] += int(sums[0])
                if len(starts) == 1:
                    continue
                self.close(d)
                starts, sums, live = starts[1:], sums[1:], live[1:]
            elif before:
                self.close(d)
            elif live[0] and self.fresh:  # it may have begun in the range before
                if len(starts) == 1:
                    self.open[d] = [head[: d + 1], int(sums[0]), True]
                    continue
                self.add(["\t".join(head[: d + 1])], d, [int(sums[0])])
                starts, sums, live = starts[1:], sums[1:], live[1:]
            if live[-1]:
                self.open[d] = [parts[int(starts[-1])].as_py()[: d + 1], int(sums[-1]), False]
            done = np.flatnonzero(live[:-1] & (sums[:-1] >= self.least))
            if len(done):
                found = pc.list_slice(parts.take(pa.array(starts[done])), 0, d + 1)
                self.add(pc.binary_join(found, "\t").to_pylist(), d, sums[done].tolist())
        self.fresh = False

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield pa.record_batch([pa.array(self.keys, pa.string()), pa.array(self.words, pa.int32()), pa.array(self.n, pa.int64())], names=["key", "words", "n"])
            self.keys, self.words, self.n = [], [], []

    def feed(self, batch: pa.RecordBatch) -> None:
        place = batch.column("part").to_numpy()
        parts, n = pc.split_pattern(batch.column("key"), "\t"), batch.column("n").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(place)) + 1, len(place))
        start = 0
        for stop in cuts.tolist():
            if place[start] != self.part:
                self.finish()
                self.part, self.fresh = place[start], True
            self.push(parts[start:stop], n[start:stop])
            start = stop


def _count(max_words: int, min_count: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(max_words, min_count)
        for batch in batches:
            if batch.num_rows:
                stack.feed(batch)
                yield from stack.rows()
        stack.finish()
        stack.add(list(stack.totals), 0, list(stack.totals.values()))
        yield from stack.rows()

    return work


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", ranges: int | None = None) -> DataFrame:
    """(key, words, n): all phrases of up to ``max_words`` words with ``min_count`` occurrences in a language, and with 0 words each language's words.

    ``ranges`` is the number of tasks that count, by default one for each 1,048,576 words (as their bytes tell) up to 16,384.
    """
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if ranges is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 6 // RANGE_ROWS))
    bounds = range_bounds(docs, ranges, max_words)
    dealt = suffixes(docs, max_words, bounds).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.desc("key"))
    counted = dealt.mapInArrow(_count(max_words, min_count), "key string, words int, n long")
    total = counted.groupBy("key", "words").agg(F.sum("n").alias("n"))
    return save(total.where((F.col("words") == 0) | (F.col("n") >= min_count)), "phrases")


def _with_part(cuts: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    used = cuts.groupBy(part).agg(F.count("*").alias("n"))
    keyed = used.join(counts.select(F.col("key").alias(part), F.col("n").alias(out)), part)
    return attach(cuts, keyed, part)


def phrase_scores(counts: DataFrame) -> DataFrame:
    """(key, words, a, l, r, score) of every phrase of two words or more: the cut with the lowest score, the first of equals."""
    some = counts.where("words >= 1").select("key", "n")
    lang = F.substring_index("key", "\t", 1)
    cuts = counts.where("words >= 2").select("key", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(key, '\t', k + 1)"), "rest": F.concat(lang, F.lit("\t"), F.expr("substring_index(key, '\t', k - words)"))})
    both = _with_part(save(_with_part(save(cuts, "cuts"), some, "first", "l"), "cuts-first"), some, "rest", "r")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    least = both.groupBy("key", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("key", "words", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """(key, longest): the largest count of a longer phrase that holds the phrase."""
    spans = F.expr("flatten(transform(sequence(2, words - 1), len -> transform(sequence(2, words - len + 2), at -> array_join(concat(slice(w, 1, 1), slice(w, at, len)), '\t'))))")
    longer = counts.where("words >= 3").withColumn("w", F.split("key", "\t"))
    return longer.select(F.explode(spans).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, subsumed_percent: int = SUBSUMED_PERCENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    a, l, r are the occurrences of the phrase and of its two parts at its worst cut, n all words of the language, score is floor(2000000 a / (l + r)).
    A phrase goes if a longer one that holds it has ``subsumed_percent`` of its occurrences.
    """
    counts = phrase_counts(docs, max_words, min_count, text_col, lang_col)
    scored = phrase_scores(counts).join(subsumed(counts), "key", "left")
    kept = scored.where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed_percent * F.col("a")))
    phrase = F.replace(F.expr("substr(key, locate('\t', key) + 1)"), F.lit("\t"), F.lit(" "))
    kept = kept.select(F.substring_index("key", "\t", 1).alias("code"), _unescape(phrase).alias("phrase"), "a", "l", "r", "score")
    placed = save(running_sums(kept, ["code", F.desc("score"), F.desc("a"), "phrase"], {"place": F.lit(1)}), "phrases-placed")  # no task holds a language
    ahead = placed.groupBy("code").agg((F.min("place") - 1).alias("ahead"))
    best = placed.join(ahead, "code").withColumn("rank", F.col("place") - F.col("ahead")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select(F.col("key").alias("code"), "n")
    return best.join(words, "code").select(_unescape(F.col("code")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op11_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS pid, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
w AS (SELECT pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT pid, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k FROM t, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS words FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND n >= 30),
u AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * u.a // (x.n + y.n) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.k = u.cut AND x.phrase = array_to_string(ws[:cut], ' ') JOIN f y ON y.lang = u.lang AND y.k = u.k - u.cut AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(ws[b:b + m - 1], ' ') AS phrase, max(n) AS longest FROM (
        SELECT lang, k, n, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS m FROM c), range(1, 4) AS q(b) WHERE b + m - 1 <= k GROUP BY 1, 2),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.longest IS NULL OR 100 * o.longest < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, words AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN tot USING (lang) WHERE rank <= 2000"""
}
