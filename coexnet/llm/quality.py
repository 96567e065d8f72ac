"""Quality classifier by positive-unlabelled learning.

A small network scores style features of a text. It is fitted on trusted
positives (training labels 1) and unlabelled documents by minimising the
non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss;
where the second term of a batch is below zero its gradient is turned round.

The class prior is estimated from positives and unlabelled documents alone: a logistic
model learns to tell them apart on half of the positives; at a score that a share ``a`` of the other half
reaches and a share ``b`` of the unlabelled, ``b / a`` is the prior plus what negatives add, and
its mean over the scores that 50 to 95 % of the positives reach is taken. Labels other than 1 are never read.

Every unlabelled training document takes part: their features (about 150 bytes a
document) lie in the shared folder in shards of about ``shard_rows``; rounds of training on each shard are
followed by the mean of the networks, weighted by rows. Positives are a
bounded sample, at most ``max_positive`` labelled rows (the smallest hashes of their
ids), sent to all shards. Scoring covers every whole text.

Defined cases: null text is empty and gets a score like any other; null ids
are scored but never used for fitting, and aren't held out; null labels are ignored; an id labelled 1
in any row is a positive, and repeated ids count once (the least of their features); without positives
or without unlabelled text every score is 0.5;
an empty table gives no rows. Other columns than id and text are not read.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import save, split_words, table, text_slices

MAX_POSITIVE = 20_000
SHARD_ROWS = 50_000
ROUNDS, STEPS = 3, 1000
HIDDEN = 24
SEED = 7

_BYTES = np.arange(256)
_upper = (_BYTES >= 65) & (_BYTES <= 90)
_lower = (_BYTES >= 97) & (_BYTES <= 122)
_digit = (_BYTES >= 48) & (_BYTES <= 57)
_space = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_mark = (_BYTES > 32) & (_BYTES < 127) & ~_upper & ~_lower & ~_digit
_soft = np.isin(_BYTES, [44, 46])
_CLASSES = np.stack([_upper, _lower, _digit, _space, _mark & ~_soft, _BYTES == 44, _BYTES == 46, _BYTES == 10, (_BYTES >= 128) & (_BYTES < 192), _BYTES >= 192, np.isin(_BYTES, [33, 63]), _BYTES == 124], 1).astype(np.float64)
FEATURES = _CLASSES.shape[1] + 13


def features(texts: pa.Array) -> np.ndarray:
    """Style features (rows x FEATURES) of whole texts, all ratios or logarithms."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    out = np.zeros((n, FEATURES))
    if not n:
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    k = _CLASSES.shape[1]
    out[:, :k] = hist @ _CLASSES / np.maximum(sizes, 1)[:, None]
    out[:, k] = np.log1p(sizes)
    p = hist / np.maximum(sizes, 1)[:, None]
    out[:, k + 1] = -(p * np.log(np.where(p > 0, p, 1))).sum(1)

    def per_row(flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, minlength=n)

    marks = _mark[data]
    run = np.flatnonzero(marks[1:] & marks[:-1]) + 1
    run_row = np.searchsorted(offsets, run, side="right") - 1
    out[:, k + 2] = np.bincount(run_row, minlength=n) / np.maximum(sizes, 1)

    owner, codes, names = split_words(texts, lower=False)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    length = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.float64) if len(names) else np.empty(0)
    w_len = length[codes]
    out[:, k + 3] = np.log1p(words)
    out[:, k + 4] = mean = per_row(w_len, owner) / some
    out[:, k + 5] = np.sqrt(np.maximum(0, per_row(w_len**2, owner) / some - mean**2))
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    out[:, k + 6] = per_row(again, owner) / some
    pair, count = np.unique(owner * max(1, len(names)) + codes, return_counts=True)
    row = pair // max(1, len(names))
    out[:, k + 7] = np.bincount(row, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    out[:, k + 8] = top / some
    out[:, k + 9] = per_row(w_len > 25, owner) / some

    lines = pc.split_pattern(texts, "\n")
    flat = pc.dictionary_encode(pc.list_flatten(lines))
    l_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    l_code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(l_owner, minlength=n)
    out[:, k + 10] = np.log1p(count)
    out[:, k + 11] = np.bincount(np.unique(l_owner * max(1, len(flat.dictionary)) + l_code) // max(1, len(flat.dictionary)), minlength=n) / np.maximum(count, 1)
    out[:, k + 12] = np.log1p(words / np.maximum(count, 1))
    return out


class PuNetwork:
    """One hidden layer on standardised features, fitted by the non-negative PU risk."""

    def __init__(self, prior: float, hidden: int = HIDDEN, seed: int = SEED):
        self.prior, self.hidden, self.seed = float(np.clip(prior, 0.02, 0.98)), hidden, seed
        self.w: list[np.ndarray] | None = None

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.w
        h = np.tanh(z @ w1 + b1)
        return h, h @ w2 + b2[0]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def start(self, mean: np.ndarray, std: np.ndarray) -> PuNetwork:
        self.mean, self.std = mean, std + 1e-6
        rng, d = np.random.default_rng(self.seed), len(mean)
        self.w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def put(self, flat: np.ndarray) -> PuNetwork:
        parts = np.split(flat, np.cumsum([x.size for x in self.w])[:-1])
        self.w = [p.reshape(x.shape) for p, x in zip(parts, self.w, strict=True)]
        return self

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, first: int = 0, steps: int = ROUNDS * STEPS, total: int = ROUNDS * STEPS, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4) -> PuNetwork:
        """Steps ``first`` to ``first + steps`` out of ``total``; starts afresh if nothing was learned before."""
        if not len(positive) or not len(unlabelled):
            return self
        if self.w is None:
            self.start(unlabelled.mean(0), unlabelled.std(0))
        p, u = self._scaled(positive), self._scaled(unlabelled)
        rng = np.random.default_rng([self.seed, first])
        m, v = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        for t in range(1, steps + 1):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            x = np.concatenate([xp, xu])
            h, g = self._forward(x)
            loss, grad = pu_risk(g[:batch], g[batch:], self.prior)
            back = np.outer(grad, self.w[2]) * (1 - h * h)
            grads = [x.T @ back, back.sum(0), h.T @ grad, np.array([grad.sum()])]
            lr = rate * (1 - (first + t) / (total + 1))
            for i, gr in enumerate(grads):
                gr = gr + decay * self.w[i]
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                self.w[i] = self.w[i] - lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-self._forward(self._scaled(x))[1]))


def pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the outputs for positives and unlabelled, and the step's gradient for both (turned round where the risk of negatives is below 0)."""
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))  # sigmoid loss: l(g, +) = 1 - s, l(g, -) = s
    rest = su.mean() - prior * sp.mean()
    dp, du = sp * (1 - sp) / len(gp), su * (1 - su) / len(gu)
    grad = np.concatenate([-2 * prior * dp, du]) if rest >= 0 else np.concatenate([prior * dp, -du])
    return prior * (1 - sp).mean() + max(0.0, rest), grad


def tell_apart(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, batch: int = 512, rate: float = 0.1, seed: int = SEED) -> np.ndarray:
    """Weights (the constant last) of a logistic model of positive against unlabelled rows, both standardised."""
    rng, w = np.random.default_rng(seed), np.zeros(positive.shape[1] + 1)
    for _ in range(steps):
        x = np.concatenate([positive[rng.integers(0, len(positive), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]])
        g = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - np.repeat([1.0, 0.0], batch)
        w[:-1] -= rate * (x.T @ g / (2 * batch) + 1e-4 * w[:-1])
        w[-1] -= rate * g.mean()
    return w


def _matrix(batches, column: int = 1) -> np.ndarray:
    rows = [x.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES) for x in (b.column(column) for b in batches) if len(x)]
    return np.concatenate(rows) if rows else np.empty((0, FEATURES))


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f) once for each id, written to the shared folder."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("f", T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in text_slices(batches, "text"):
            f = features(b.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, FEATURES, dtype=np.int32)), pa.array(f.ravel()))], names=["id", "f"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return save(rows.groupBy("id").agg(F.min("f").alias("f")), "quality-features")


def _weighted_mean(shards: DataFrame, learn) -> np.ndarray | None:
    """The mean, weighted by rows, of the vectors that ``learn`` makes of each task's features; rounded, as the order of sums is free."""

    def run(batches):
        x = _matrix(batches, 0)
        if len(x):
            v = learn(x)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int32()), pa.array(v * len(x)), pa.array(np.full(len(v), float(len(x))))], names=["i", "v", "n"])

    mean = F.round(F.sum("v") / F.sum("n"), 9).alias("v")
    rows = shards.select("f").mapInArrow(run, "i int, v double, n double").groupBy("i").agg(mean).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])]) if rows else None


def deal(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, f): a task holds one shard, the same rows in the same order in every run."""
    shard = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    return rows.select(shard, "f").repartitionById(shards, F.col("shard")).sortWithinPartitions("f")


def fit_quality(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = MAX_POSITIVE, shard_rows: int = SHARD_ROWS, prior: float | None = None, seed: int = SEED) -> PuNetwork:
    """Fit on the documents whose id passes ``training`` (a function of the id column); estimates ``prior`` if it is not given."""
    ids = labels.select(F.col(id_col).alias("id")).where(training(F.col("id")) & F.col("id").isNotNull() & (F.col(label_col) == 1)).distinct()
    chosen = ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_positive)  # small enough to send to all
    rows = feature_table(docs.where(F.col(id_col).isNotNull() & training(F.col(id_col))), id_col, text_col)
    known = rows.join(F.broadcast(chosen), "id", "left_semi").toPandas()
    model = PuNetwork(0.5 if prior is None else prior, seed=seed)
    n = rows.count()
    if not len(known) or not n:
        return model
    positive = np.stack(known["f"].to_numpy()).astype(np.float64)
    positive = positive[np.lexsort(positive.T)]  # the same rows in the same order, however they arrive
    positive = positive[np.random.default_rng(seed).permutation(len(positive))]

    shards = -(-n // shard_rows)
    dealt = deal(rows, shards, seed)
    moments = _weighted_mean(rows, lambda x: np.concatenate([x.mean(0), (x * x).mean(0)]))
    mean, square = moments[:FEATURES], moments[FEATURES:]
    model.start(mean, np.sqrt(np.maximum(square - mean * mean, 0)))
    if prior is None:
        model.prior = float(np.clip(_prior(model, positive, dealt, rows), 0.02, 0.98))
    for r in range(ROUNDS):
        model.put(_weighted_mean(dealt, lambda x, m=model, r=r: copy.deepcopy(m).fit(positive, x, r * STEPS, STEPS).flat()))
    return model


def _prior(model: PuNetwork, positive: np.ndarray, dealt: DataFrame, rows: DataFrame) -> float:
    """Share of positives among all rows (see above); one row: half and half."""
    p = model._scaled(positive)
    learn, ask = (p[::2], p[1::2]) if len(p) > 1 else (p, p)
    w = _weighted_mean(dealt, lambda x: tell_apart(learn, model._scaled(x), seed=model.seed))
    at = np.quantile(ask @ w[:-1] + w[-1], np.linspace(0.05, 0.5, 19))
    above = _weighted_mean(rows, lambda x: ((model._scaled(x) @ w[:-1] + w[-1])[:, None] >= at).mean(0))
    return float((above / ((ask @ w[:-1] + w[-1])[:, None] >= at).mean(0)).mean())


def score_quality(docs: DataFrame, model: PuNetwork, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (replaced if it is there)."""
    rest = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for b in text_slices(batches, text_col):
            s = model.score(features(b.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(s)], names=[*rest, score_col])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
