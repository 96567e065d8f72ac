"""Scoring of texts by a causal self-attention model over subword ids.

Tokens are the words of the text in lower case (A-Z) and one end. Words are
cut into subwords by a public vocabulary; the model (see ``attention``)
predicts subword after subword and the end, so a text's probability is the
product over all of them. Its symbols are the most frequent subwords of the
training documents; the other ones share one symbol, and their own share of it is
their add-one frequency among all ids of the vocabulary that have no symbol.

What is learned covers the training documents: word counts come from all
their words, subword counts from all word counts, and the network is
trained on the whole text of every training document, at every size of the
corpus; a corpus that would leave a round under ``LEAST_CHARS`` characters has its
documents in more rounds than one, and one under ``LEAST_STEPS`` steps is gone over again. Training runs in rounds; in each, one task trains on every
``SHARD_CHARS`` characters of the round's documents, so the tasks grow with the
corpus, and the mean of their parameters, weighted by targets, starts the next
round. The parameters are added up in ``PARAM_BLOCKS`` blocks by tasks of their
own; one set of them reaches the driver, whatever the number of shards.

Each text is cut once: its run of symbols is written, 16 bits each, and neighbour
counts, training and scoring read the runs.

A text's score is the network's alone: the sum over the subwords of all its
words, and its end. A word that the vocabulary cuts into nothing counts as its
unknown piece.

The base needs the count of each word. Words of at least
``1 / HOT_WORDS`` of all training tokens are at most HOT_WORDS, so the 64-bit
hashes and counts of these are sent to all tasks; all others meet their counts
in a join, once for each text that holds them.

Defined cases: null text is empty and has the end as its only token; a null
id is neither held out nor learned from; rows are scored one by one, so
repeated rows repeat (and count repeatedly in training); without training
documents the network stays a uniform start and base scores are 0; an empty
table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coexnet.llm.attention import BLOCK, RARE, START, SYMBOLS, Adam, Attention, balanced_classes, window_ids, windows
from coexnet.llm.common import save, split_words, table, text_slices, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT_WORDS = 1 << 20
HOT_BYTES = 64
CACHED_WORDS = 200_000
SHARD_CHARS, LEAST_CHARS = 8_000_000, 2_500_000
PARAM_BLOCKS = 64
SLICE_BYTES, CUT_BYTES = 1 << 20, 4 << 20
ROUNDS, RATE, LEAST_STEPS = 4, 3e-2, 500


class Subwords:
    """Subword ids of distinct words; the word starts with the vocabulary's word mark.

    Remembers up to ``CACHED_WORDS`` words of at most HOT_BYTES characters between calls.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.unknown = [max(0, self.model.unk_id())]
        self.known: dict[str, list[int]] = {}

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        names = words.to_numpy(zero_copy_only=False).tolist() if len(words) else []
        new = [w for w in names if w not in self.known]
        fresh = dict(zip(new, self.model.encode(new, num_threads=1), strict=True)) if new else {}
        cut = [self.known.get(w) or fresh[w] or self.unknown for w in names]
        if len(self.known) + len(fresh) > CACHED_WORDS:  # frequent words are in this call, too
            self.known = {w: x for w in names[:CACHED_WORDS] if (x := self.known.get(w))}
        self.known.update((w, x) for w, x in fresh.items() if x and len(w) <= HOT_BYTES)
        length = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter(chain.from_iterable(cut), np.int64, int(length.sum())), length


class Symbols:
    """Maps subword ids (and the end, which is the id after the last) to the model's symbols."""

    def __init__(self, counts: np.ndarray):
        """counts: of each id in the training documents, the end last."""
        order = np.lexsort((np.arange(len(counts)), -counts))[: SYMBOLS - 1]
        if len(counts) - 1 not in order:
            order[-1] = len(counts) - 1
        self.of = np.full(len(counts), RARE, np.int64)
        self.of[order] = np.arange(len(order))
        rare = self.of == RARE
        self.extra = np.where(rare, np.log10((counts + 1.0) / (counts[rare].sum() + max(1, rare.sum()))), 0.0)
        self.counts = np.bincount(self.of, counts, minlength=SYMBOLS)


def expand(first: np.ndarray, length: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Positions of the items of each picked run, one after another."""
    n = length[pick]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[pick], n)


class Sequences:
    """Texts as words, and as runs of symbols, one run a row.

    names: distinct words (large strings); codes, owner: the words of all rows,
    where code ``len(names)`` is the end of a row; flat: symbols of all words;
    pieces: symbols of each word; extra: log10 share of rare subwords for each
    distinct word; start, length: each row's run in ``flat``.
    """

    def __init__(self, texts: pa.Array, cut: Subwords, symbols: Symbols):
        rows = len(texts)
        owner, codes, self.names = split_words(texts)
        ids, n_ids = cut(self.names)
        place = np.arange(len(codes)) + owner
        self.codes = np.full(len(codes) + rows, len(self.names), np.int64)
        self.codes[place] = codes
        self.n_words = np.bincount(owner, minlength=rows) + 1
        self.owner = np.repeat(np.arange(rows), self.n_words)
        first, n_ids = np.append(np.cumsum(n_ids) - n_ids, len(ids)), np.append(n_ids, 1)
        ids = np.append(ids, len(symbols.of) - 1)
        self.flat = symbols.of[ids[expand(first, n_ids, self.codes)]]
        self.extra = np.bincount(np.repeat(np.arange(len(n_ids)), n_ids), symbols.extra[ids], minlength=len(n_ids))
        self.pieces = n_ids[self.codes]
        self.length = np.bincount(self.owner, self.pieces, minlength=rows).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length


def shifted(flat: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Inputs: each symbol's predecessor; ``begin`` before the first of a row."""
    x = np.empty_like(flat)
    x[1:] = flat[:-1]
    some = length > 0
    x[start[some]] = begin[some]
    return x


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all words of ``docs.text``; summed per slice of text before the shuffle."""

    def count(batches):
        for b in text_slices(batches, "text"):
            _, codes, names = split_words(b.column("text"))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(names)))], names=["word", "n"])

    return save(docs.select("text").mapInArrow(count, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")


def subword_counts(words: DataFrame, vocabulary: str, n_docs: int) -> np.ndarray:
    """Count of each subword id in the training documents, and of the end; as many rows reach the driver as the vocabulary has ids."""

    def count(batches):
        cut, total = Subwords(vocabulary), None
        for b in batches:
            ids, length = cut(b.column(0))
            n = np.repeat(b.column(1).to_numpy(), length)
            part = np.bincount(ids, n, minlength=cut.size)
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    out = np.zeros(Subwords(vocabulary).size + 1)
    for r in words.select("word", "c").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    out[-1] = n_docs
    return out


def training_texts(docs: DataFrame, rounds: int, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, int]:
    """((round, shard, at, text) of every document, whole, and the number of shards of about ``shard_chars`` characters a round)."""
    return dealt(docs.select(*text_facts(), "text"), rounds, shard_chars)


def text_facts():
    """What places a document: a hash and its number of characters."""
    return F.xxhash64("doc_id", "text").alias("at"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")


def dealt(docs: DataFrame, rounds: int, shard_chars: int) -> tuple[DataFrame, int]:
    """``docs`` (at, chars, ...) with their rounds and shards, and the number of shards a round."""
    total = docs.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("n")).first()["n"]
    times = max(1, min(rounds, -(-rounds * LEAST_CHARS // max(1, total))))  # rounds that a document is in
    shards = max(1, -(-total * times // (rounds * shard_chars)))
    spread = F.pmod(F.xxhash64("at", F.lit(3)), F.lit(rounds * shards))
    each = F.explode(F.array(*(((spread + k) % rounds).cast("int") for k in range(times)))).alias("round")
    return docs.select(each, F.floor(spread / rounds).cast("int").alias("shard"), *(c for c in docs.columns if c != "chars")), shards


def packed(q: Sequences) -> pa.Array:
    """The rows' runs of symbols, 16 bits each."""
    offsets = 2 * np.append(q.start, len(q.flat))
    return pa.Array.from_buffers(pa.large_binary(), len(q.start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(q.flat.astype(np.uint16))])


def unpacked(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start and length of each row) of such runs."""
    runs = runs.cast(pa.large_binary())
    _, offsets, data = runs.buffers()
    at = np.frombuffer(offsets, np.int64)[runs.offset : runs.offset + len(runs) + 1] // 2
    flat = np.frombuffer(data, np.uint16)[at[0] : at[-1]] if data is not None else np.zeros(0)
    return flat.astype(np.int64), at[:-1] - at[0], np.diff(at)


def symbol_runs(texts: DataFrame, vocabulary: str, symbols: Symbols) -> DataFrame:
    """``texts`` with ``run`` in place of ``text``; those that have it are as they are."""
    if "run" in texts.columns:
        return texts
    names = [c for c in texts.columns if c != "text"]

    def cut_all(batches):
        cut = Subwords(vocabulary)
        for b in text_slices(batches, "text", CUT_BYTES):
            run = packed(Sequences(b.column("text"), cut, symbols)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), run], names=[*names, "run"])

    return save(texts.select(*names, "text").mapInArrow(cut_all, ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names) + ", run binary"), "lm-runs")


def _text_windows(batch: pa.RecordBatch, cut: Subwords, symbols: Symbols, most: int):
    """(ids, targets, real) of all windows of the texts, ``most`` windows at once."""
    q = Sequences(batch.column("text"), cut, symbols)
    yield from _run_windows(q.flat, q.start, q.length, most)


def _run_windows(flat: np.ndarray, start: np.ndarray, length: np.ndarray, most: int):
    x = shifted(flat, start, length, np.full(len(start), START))
    row, at = windows(length)
    for a in range(0, len(row), most):
        yield window_ids(x, flat, start, length, row[a : a + most], at[a : a + most])


def neighbour_counts(texts: DataFrame, vocabulary: str, symbols: Symbols) -> np.ndarray:
    """How often symbol b follows symbol a in the texts (SYMBOLS x 2 SYMBOLS: following and preceding)."""

    def count(batches):
        total = np.zeros(SYMBOLS**2, np.int64)
        for b in text_slices(batches, "run", SLICE_BYTES):
            flat, start, _ = unpacked(b.column("run"))
            pair = np.ones(max(0, len(flat) - 1), bool)
            pair[start[start > 0] - 1] = False
            total += np.bincount((flat[:-1] * SYMBOLS + flat[1:])[pair], minlength=SYMBOLS**2)
        a, b = np.divmod(np.flatnonzero(total), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[total > 0])], names=["a", "b", "n"])

    out = np.zeros((SYMBOLS, SYMBOLS))
    rows = symbol_runs(texts, vocabulary, symbols).select("run").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    out[rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return np.concatenate([out, out.T], 1)


def train(texts: DataFrame, vocabulary: str, symbols: Symbols, rounds: int = ROUNDS, shards: int = 1, rate: float = RATE, batch: int = 128, least_steps: int = LEAST_STEPS) -> Attention:
    """Rounds of local training with averaged parameters, on texts or their runs. Reruns agree: a task is a shard, and shards and their order are fixed by hashes."""
    spark = texts.sparkSession
    runs = symbol_runs(texts, vocabulary, symbols)
    model = Attention.fresh(balanced_classes(neighbour_counts(runs, vocabulary, symbols)), symbols.counts)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model.to_bytes(), model))

        def learn(batches, sent=sent, r=r):
            data, shape = sent.value
            own, opt = shape.from_bytes(data), Adam(rate)
            held, steps, weight = [], 0, 0

            def epoch(parts):
                nonlocal steps
                ids, target, real = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.random.default_rng(steps).permutation(len(ids))
                for a in range(0, len(ids), batch):
                    pick = order[a : a + batch]
                    share = max(0.05, 1 - (r + min(1.0, steps / least_steps / 2)) / rounds)
                    opt.step(own.p, own.gradients(ids.take(pick, 0), target.take(pick, 0), real.take(pick, 0)), share)
                    steps += 1

            small = []
            for b in text_slices(batches, "run", SLICE_BYTES):
                for part in _run_windows(*unpacked(b.column("run")), 64 * batch):
                    weight += int(part[2].sum())
                    held.append(part)
                    if sum(len(x[0]) for x in small) < least_steps * batch:
                        small.append(part)
                    if sum(len(x[0]) for x in held) >= 64 * batch:
                        epoch(held)
                        held = []
            if held:
                epoch(held)
            for _ in range(20):  # a little corpus is gone over again
                if not small or steps >= least_steps:
                    break
                epoch(small)
            if weight:
                flat = np.frombuffer(own.to_bytes(), np.float32)
                parts = [x.tobytes() for x in np.array_split(flat, PARAM_BLOCKS)]
                shard = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(PARAM_BLOCKS), pa.int32()), pa.array([shard] * PARAM_BLOCKS), pa.array([weight] * PARAM_BLOCKS), pa.array(parts)], names=["block", "shard", "weight", "params"])

        part = runs.where(F.col("round") == r).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "at", "run")
        got = save(part.mapInArrow(learn, "block int, shard long, weight long, params binary"), "lm-params")
        rows = got.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_add_up, "block int, weight long, params binary").collect()
        if rows:
            mean = np.concatenate([np.frombuffer(x["params"], np.float64) / x["weight"] for x in sorted(rows, key=lambda x: x["block"])])
            model = model.from_bytes(mean.astype(np.float32).tobytes())
        sent.unpersist()
    return model


def _add_up(batches):
    """(block, weight, weighted sum) of the parameters of each block, in the order of the shards; holds one sum a block."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for k, weight, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            part = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * weight
            total, held = sums.get(k, (0, 0.0))
            sums[k] = total + weight, held + part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["block", "weight", "params"])


def symbol_logs(model: Attention, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of every symbol given its row so far; each is scored in one window."""
    x = shifted(flat, start, length, np.full(len(start), START))
    row, at = windows(length)
    out = np.zeros(len(flat))
    for a in range(0, len(row), BLOCK):
        r, k = row[a : a + BLOCK], at[a : a + BLOCK]
        ids, target, real = window_ids(x, flat, start, length, r, k)
        where = (k + start[r])[:, None] + np.arange(target.shape[1])
        out[where[real]] = model.log_prob(ids, target)[real]
    return out / np.log(10)


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows whose id passes ``training``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("learned", F.coalesce(training(F.col("doc_id")), F.lit(False)))
    words = word_counts(docs.where("learned"))
    n_docs = docs.where("learned").select("doc_id").count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, n_distinct = n_words + n_docs, distinct + (n_docs > 0)
    least = float(np.log10(1.0 / (n_train + n_distinct + 1)))
    symbols = Symbols(subword_counts(words, vocabulary, n_docs))

    hot_from = max(2, -(-n_train // HOT_WORDS))
    is_hot = (F.col("c") >= hot_from) & (F.octet_length("word") <= HOT_BYTES)
    hot = words.where(is_hot).toArrow()  # at most HOT_WORDS words of HOT_BYTES
    hashes = word_hashes(hot["word"])
    order = np.argsort(hashes)
    counted = spark.sparkContext.broadcast((symbols, hashes[order], hot["c"].to_numpy()[order]))
    kept = ["doc_id", "learned", "at", "chars"]
    docs = docs.select("doc_id", "learned", *text_facts(), "text")
    schema = "row long, " + ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", n_tokens long, known long, base double, rare double, word array<string>, times array<int>, run binary"

    def cut_all(batches):
        sym, hot_words, hot_counts = counted.value
        cut = Subwords(vocabulary)
        log_c = np.append(np.log10(hot_counts + 1.0), 0.0)
        row_no = TaskContext.get().partitionId() << 40
        for b in text_slices(batches, "text", CUT_BYTES):
            q = Sequences(b.column("text"), cut, sym)
            rows, width = b.num_rows, max(1, len(q.names))
            own = word_hashes(q.names)
            at = np.searchsorted(hot_words, own)
            hit = at < len(hot_words)
            hit[hit] = hot_words[at[hit]] == own[hit]
            at = np.append(np.where(hit, at, len(hot_counts)), len(hot_counts))[q.codes]  # the last place: rare, or the end
            is_end, sure = q.codes == len(q.names), at < len(hot_counts)
            known = np.bincount(q.owner, sure | is_end & (n_docs > 0), minlength=rows).astype(np.int64)
            base = np.bincount(q.owner, log_c[at], minlength=rows) + np.log10(n_docs + 1.0) + q.n_words * least
            extra = np.bincount(q.owner, q.extra[q.codes], minlength=rows)
            rare = ~sure & ~is_end
            pair, times = np.unique(q.owner[rare] * width + q.codes[rare], return_counts=True)
            offsets = np.searchsorted(pair // width, np.arange(rows + 1)).astype(np.int32)
            rare_words = q.names.take(pa.array(pair % width)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row_no, row_no + rows)), *(b.column(c) for c in kept), pa.array(q.n_words.astype(np.int64)), pa.array(known), pa.array(base), pa.array(extra)]
                + [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (rare_words, pa.array(times.astype(np.int32)))]
                + [packed(q).cast(pa.binary())],
                names=["row", *kept, "n_tokens", "known", "base", "rare", "word", "times", "run"],
            )
            row_no += rows

    rows = save(docs.mapInArrow(cut_all, schema), "lm-rows")
    runs, shards = dealt(rows.where("learned").select("at", "chars", "run"), rounds, shard_chars)
    sent = spark.sparkContext.broadcast(train(runs, vocabulary, symbols, rounds, shards))

    def score(batches):
        net = sent.value.frozen()
        for b in text_slices(batches, "run", SLICE_BYTES):
            flat, start, length = unpacked(b.column("run"))
            s = np.bincount(np.repeat(np.arange(b.num_rows), length), symbol_logs(net, flat, start, length), minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(s + b.column("rare").to_numpy())], names=[*b.schema.names[:-2], "score"])

    shown = ["row", "doc_id", "n_tokens", "known", "base"]
    scored = rows.select(*shown, "rare", "run").mapInArrow(score, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in shown) + ", score double")
    scored = save(scored, "lm-scores")
    rare = rows.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    found = rare.join(words.where(~is_hot), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain"))
    out = scored.join(found, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score")


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    s = score_texts(docs, lambda c: F.crc32(c.cast("string")) % 7 != 2)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
