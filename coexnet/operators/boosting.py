"""Boosted regression trees of many targets together, with cross-validated rounds, on packed cells.

Cells are dealt to chunks, targets to blocks; a row of the state holds a chunk of a block: the bins of its regulators (a byte a cell), what is to
be fitted, each cell's fold and the predictions of all models. A target has a model for all cells and one for each fold, which
leaves that fold's cells out; they grow together, a level at a time. A level is one pass over the state: every task adds up
its histograms of (target, model, node, regulator, bin) and emits each once (once a block, if all are more than ``HELD_BYTES``), and there are
no more tasks than twice the cluster's cores, so what is shuffled has the size of the models, not of the cells. Leaves come from the sums
of the splits. Trees are sent to the tasks, which add those since the last written state to its predictions; the state itself is never shuffled, and
is written only every ``WRITE_ROUNDS`` rounds, without the predictions of targets that have stopped. Held-out squared errors are another pass.

Cells of one fold with the same bins of all of a target's regulators always get the same prediction: they are one kind of cell. Where a target has few kinds
(``KIND_SHARE`` cells or more to each, by an estimate that decides on nothing else), its cells are added up once, before the first round: a kind keeps
its number of cells and the sums of their values and squares, which is all that histograms and errors need. Rounds then cost what
kinds cost, however many cells there are; the others keep their cells.

The best round of a target is the first with the least mean over folds of the held-out root mean squared error; a target stops, and
is passed over from then on, when ``patience`` rounds in a row were no better. The first rounds of the model of all cells are
what a refit with that many would give, so they are kept and the others left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coexnet.operators.rounds import keep

CHUNK_CELLS, BLOCK_TARGETS, CHECK_ROUNDS, WRITE_ROUNDS, HELD_BYTES = 4096, 32, 4, 10, 1 << 26
KIND_SHARE, CHUNK_KINDS, SKETCH, HELD_KINDS = 4, 1 << 15, 64, 1 << 21
SIDES = [(np.arange(256) >> i & 1).astype(bool) for i in range(8)]  # the sides that a byte of answers tells
HEAD, BINS, VALUES = range(3)
STATE = "chunk int, block int, info string, folds binary, bins binary, y binary, f binary, n binary, yy binary"
WITHOUT_F = STATE.replace("f binary, ", "")
SUMS = "gene string, part int, info string, code binary, n binary, y binary, yy binary"
SPLIT = "gene string, model int, node int, tf string, at int, gain double, cover long, gl double, nl long, ga double, na long"
HISTOGRAM = "gene string, model int, tf string, node int, bin int, g double, n long"


def regulator_bins(expr: DataFrame, links: DataFrame, n_bins: int) -> tuple[DataFrame, DataFrame]:
    """(cell, tf, bin) of values other than 0, and (tf, zero): the bin of those.

    Bins are cut at ``n_bins`` quantiles of a regulator's values other than 0 and at 0; values at a cut have a bin of their own.
    """
    share = F.array(*(F.lit(i / n_bins) for i in range(1, n_bins)))
    values = expr.where("value <> 0").withColumnRenamed("gene", "tf").join(links.select("tf").distinct(), "tf", "left_semi")
    cuts = values.groupBy("tf").agg(F.array_sort(F.array_distinct(F.array_union(F.percentile_approx("value", share, F.lit(10_000)), F.array(F.lit(0.0))))).alias("cuts"))
    place = lambda v: F.size(F.filter("cuts", lambda c: c < v)) + F.size(F.filter("cuts", lambda c: c <= v))
    return values.join(F.broadcast(cuts), "tf").select("cell", "tf", place(F.col("value")).alias("bin")), cuts.select("tf", place(F.lit(0.0)).alias("zero"))


def _row(chunk: int, block: int, info: str, values: dict[int, dict[str, tuple]]) -> dict:
    told = json.loads(info)
    folds = values[HEAD][""][1].astype(np.uint8)
    bins, y = np.empty((len(told["tfs"]), len(folds)), np.uint8), np.zeros((len(told["targets"]), len(folds)))
    for out, names, given in ((bins, told["tfs"], values.get(BINS, {})), (y, told["targets"], values.get(VALUES, {}))):
        for i, x in enumerate(names):
            if out is bins:
                out[i] = x["zero"]
            at, v = given.get(x["name"], ((), ()))
            out[i, at] = v
    f = np.repeat([x["start"] for x in told["targets"]], len(folds)).reshape(len(y), -1)
    return {"chunk": chunk, "block": block, "info": info, "folds": folds.tobytes(), "bins": bins.tobytes(), "y": y.tobytes(), "f": f.tobytes()}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, block, kind, name, at, value), in order, to rows of the state with one model a target."""
    key, info, values = None, None, {}

    def done() -> Iterator[pa.RecordBatch]:
        if key is not None and info is not None:
            yield pa.RecordBatch.from_pylist([_row(*key, info, values)], schema=_schema())

    for b in batches:
        chunk, block, kind, name, told = (b.column(c).to_pylist() for c in ("chunk", "block", "kind", "name", "info"))
        for i in range(b.num_rows):
            if key != (chunk[i], block[i]):
                yield from done()
                key, info, values = (chunk[i], block[i]), None, {}
            info = told[i] or info
            values.setdefault(kind[i], {})[name[i] or ""] = (b.column("at")[i].values.to_numpy(), b.column("value")[i].values.to_numpy())
    yield from done()


def _schema(columns: str = STATE) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def packed_state(expr: DataFrame, links: DataFrame, n_bins: int, folds: int, chunk_cells: int = CHUNK_CELLS, cells: DataFrame | None = None) -> DataFrame:
    """The state before the first round; predictions are each target's mean. ``links`` is (tf, gene), ``cells`` has each cell of ``expr`` once."""
    cells = expr.select("cell").distinct() if cells is None else cells
    n_cells = cells.count()
    n_targets = links.select("gene").distinct().count()
    chunks, blocks = max(1, -(-n_cells // chunk_cells)), max(1, -(-n_targets // BLOCK_TARGETS))
    hash_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("cell").cast("string")), F.lit(max(1, folds))).cast("int") + 1
    order = Window.partitionBy("chunk").orderBy("cell")
    placed = keep(cells.withColumn("chunk", hash_of("cell", chunks)).withColumn("at", F.row_number().over(order) - 1).withColumn("fold", fold))
    binned, zero = regulator_bins(expr, links, n_bins)
    links = links.withColumn("block", hash_of("gene", blocks))
    start = expr.join(links.select("gene").distinct(), "gene", "left_semi").groupBy("gene").agg((F.sum("value") / F.lit(float(n_cells))).alias("start"))
    targets = links.join(start, "gene").groupBy("block", "gene", "start").agg(F.array_sort(F.collect_set("tf")).alias("own"))
    targets = targets.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.col("gene").alias("name"), "start", "own"))).alias("targets"))
    tfs = links.select("block", "tf").distinct().join(zero, "tf").groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.col("tf").alias("name"), "zero"))).alias("tfs"))
    info = targets.join(tfs, "block").select("block", F.to_json(F.struct("targets", "tfs")).alias("info"))

    def rows(df: DataFrame, kind: int, name, value: str) -> DataFrame:
        lists = df.groupBy("chunk", "block", name.alias("name")).agg(F.sort_array(F.collect_list(F.struct("at", F.col(value).cast("double").alias("value")))).alias("v"))
        return lists.select("chunk", "block", F.lit(kind).alias("kind"), "name", F.col("v.at").alias("at"), F.col("v.value").alias("value"), F.lit(None).cast("string").alias("info"))

    head = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", F.col("fold").cast("double").alias("value")))).alias("v"))
    head = head.join(info, F.lit(True)).select("chunk", "block", F.lit(HEAD).alias("kind"), F.lit("").alias("name"), F.col("v.at").alias("at"), F.col("v.value").alias("value"), "info")  # the state's rows
    by_tf = binned.join(placed, "cell").join(links.select("block", "tf").distinct(), "tf")
    by_gene = expr.join(links.select("block", "gene").distinct(), "gene").join(placed, "cell")
    every = head.unionByName(rows(by_tf, BINS, F.col("tf"), "bin")).unionByName(rows(by_gene, VALUES, F.col("gene"), "value"))
    return keep(every.repartition("chunk", "block").sortWithinPartitions("block", "chunk", "kind", "name").mapInArrow(_pack, STATE))


def _mixed(code: np.ndarray) -> np.ndarray:
    """Hashes of 0 to 2^63 - 1."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _added(parts: list[tuple]) -> tuple:
    """(codes, numbers, sums, sums of squares) of several, each code once."""
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n, y, yy = (np.bincount(at, np.concatenate([p[i] for p in parts]), len(code)) for i in (1, 2, 3))
    return code, n.astype(np.int64), y, yy


def _least_hashes(width: int):
    """The ``SKETCH`` least hashes of each target's kinds that a task meets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, 1)
                for t, gene in enumerate(b.targets):
                    if (code := b.codes(t, width)) is not None:
                        least[gene] = np.unique(np.concatenate([least.get(gene, code[:0]), _mixed(code)]))[:SKETCH]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, h in least.items() for _ in h], pa.string()), pa.array(np.concatenate([*least.values(), np.empty(0, np.int64)]))], names=["gene", "h"])

    return work


def _kinds(width: int, sent):
    """The sums of the kinds of some targets that a task meets; ``sent`` has their numbers of parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        infos: dict[str, str] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for gene, parts in held.items():
                sums = _added(parts)
                part = _mixed(sums[0]) % sent.value[gene]
                for p in np.unique(part):
                    own = [x[part == p].tobytes() for x in sums]
                    yield pa.RecordBatch.from_pylist([{"gene": gene, "part": int(p), "info": infos[gene]} | dict(zip(("code", "n", "y", "yy"), own, strict=True))], schema=_schema(SUMS))

        for batch in batches:
            for row in batch.to_pylist():
                b, told = _Block(row, 1), json.loads(row["info"])
                for t, gene in enumerate(b.targets):
                    if gene not in sent.value:
                        continue
                    if gene not in infos:
                        infos[gene] = json.dumps({"targets": [told["targets"][t] | {"start": 0.0}], "tfs": [told["tfs"][i] for i in b.own[t]]})
                    v = b.y[t] - told["targets"][t]["start"]
                    held.setdefault(gene, []).append(_added([(b.codes(t, width), np.ones(len(v), np.int64), v, v * v)]))
                    size += len(held[gene][-1][0])
                if size > HELD_KINDS:
                    held = {gene: [_added(parts)] for gene, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if 2 * size > HELD_KINDS:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return work


def _kind_rows(width: int):
    """Sums in order of target and part to rows of the state."""

    def row(gene: str, part: int, info: str, parts: list[tuple]) -> pa.RecordBatch:
        code, n, y, yy = _added(parts)
        bins = []
        for _ in json.loads(info)["tfs"]:
            code, last = np.divmod(code, width)
            bins.insert(0, last.astype(np.uint8))
        new = {"chunk": part, "block": -1, "info": info, "folds": code.astype(np.uint8).tobytes(), "bins": np.concatenate(bins).tobytes(), "y": y.tobytes(), "n": n.tobytes(), "yy": yy.tobytes()}
        return pa.RecordBatch.from_pylist([new], schema=_schema(WITHOUT_F))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if key is not None and key[:2] != (x["gene"], x["part"]):
                    yield row(*key, parts)
                    parts = []
                key = x["gene"], x["part"], x["info"]
                parts.append(tuple(np.frombuffer(x[c], t) for c, t in (("code", np.int64), ("n", np.int64), ("y", np.float64), ("yy", np.float64))))
        if key is not None:
            yield row(*key, parts)

    return work


def _without(sent):
    """The state's rows without the targets in ``sent`` and what only they need."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, told = _Block(row, 1), json.loads(row["info"])
                stay = [t for t, gene in enumerate(b.targets) if gene not in sent.value]
                if not stay:
                    continue
                tfs = sorted({i for t in stay for i in b.own[t]})
                info = json.dumps({"targets": [told["targets"][t] for t in stay], "tfs": [told["tfs"][i] for i in tfs]})
                new = {c: row[c] for c in ("chunk", "block", "folds")} | {"info": info, "bins": b.bins[tfs].tobytes(), "y": b.y[stay].tobytes()}
                yield pa.RecordBatch.from_pylist([new], schema=_schema(WITHOUT_F))

    return work


def by_kind(state: DataFrame, width: int, tasks: int) -> DataFrame:
    """The first state with kinds in place of cells for targets that have few of them (see above)."""
    cells = state.groupBy("block").agg(F.sum(F.length("folds")).alias("n")).agg(F.max("n")).first()[0]
    least = state.coalesce(tasks).mapInArrow(_least_hashes(width), "gene string, h long").groupBy("gene").agg(F.slice(F.array_sort(F.collect_set("h")), 1, SKETCH).alias("h"))
    kinds = F.when(F.size("h") < SKETCH, F.size("h")).otherwise(F.lit((SKETCH - 1) * 2.0**63) / (F.array_max("h") + 1))
    few = least.select("gene", kinds.alias("kinds")).where(F.col("kinds") * KIND_SHARE <= cells).collect()
    if not few:
        return state
    sent = state.sparkSession.sparkContext.broadcast({x["gene"]: -(-int(x["kinds"]) // CHUNK_KINDS) for x in few})
    sums = state.coalesce(tasks).mapInArrow(_kinds(width, sent), SUMS)
    rows = sums.repartition("gene", "part").sortWithinPartitions("gene", "part").mapInArrow(_kind_rows(width), WITHOUT_F)
    return keep(state.mapInArrow(_without(sent), WITHOUT_F).unionByName(rows))


class Trees:
    """Splits of a round's trees, by target; has the size of the models."""

    def __init__(self, splits: pa.Table):
        t = splits.sort_by([(c, "ascending") for c in ("gene", "model", "node")])
        genes = t["gene"].to_pylist()
        first = [i for i in range(len(genes)) if i == 0 or genes[i] != genes[i - 1]] + [len(genes)]
        self.span = {genes[i]: (i, j) for i, j in zip(first, first[1:], strict=False)}
        self.model, self.node, self.gl, self.ga = (t[c].to_numpy() for c in ("model", "node", "gl", "ga"))
        self.nl, self.na, self.at = (t[c].to_numpy() for c in ("nl", "na", "at"))
        self.tf = t["tf"].to_pylist()
        self.plans: dict[tuple[str, int], tuple] = {}

    def of(self, gene: str, model: int) -> range:
        low, high = self.span.get(gene, (0, 0))
        a, b = np.searchsorted(self.model[low:high], (model, model + 1))
        return range(low + int(a), low + int(b))

    def plan(self, gene: str, model: int, eta: float) -> tuple:
        """(a tree as nested (tf, at, low side, high side) with the numbers of its leaves, the step of each leaf, its splits, the step for each byte of
        their answers); the last is None where a byte does not hold them."""
        if (gene, model) not in self.plans:
            at_node, steps, asked = {int(self.node[i]): i for i in self.of(gene, model)}, [], []

            def grow(node: int, step: float):
                i = at_node.get(node)
                if i is None or self.tf[i] is None:
                    steps.append(step)
                    return np.uint16(len(steps) - 1)
                low, high = eta * self.gl[i] / (self.nl[i] + 1), eta * (self.ga[i] - self.gl[i]) / (self.na[i] - self.nl[i] + 1)
                asked.append((self.tf[i], int(self.at[i])))
                return self.tf[i], int(self.at[i]), grow(2 * node, low), grow(2 * node + 1, high)

            def answered(tree, sides: Iterator[np.ndarray]):
                if not isinstance(tree, tuple):
                    return tree
                side, low, high = next(sides), answered(tree[2], sides), answered(tree[3], sides)
                return np.where(side, high, low)

            root = at_node.get(1)
            tree = grow(1, 0.0 if root is None else eta * self.ga[root] / (self.na[root] + 1))
            steps, sides = np.array(steps), (s[: 1 << len(asked)] for s in SIDES)
            self.plans[gene, model] = tree, steps, asked, steps[answered(tree, sides)] if len(asked) <= len(SIDES) else None
        return self.plans[gene, model]


class _Block:
    """One row of the state with the trees since it was written; ``over`` has the targets that have stopped.

    Of kinds of cells, ``n`` and ``yy`` are set, ``y`` are sums, and values count from the target's mean.
    """

    def __init__(self, row: dict, models: int, past: list[Trees] = (), over: frozenset = frozenset()):
        told = json.loads(row["info"])
        self.targets, self.tfs = [x["name"] for x in told["targets"]], [x["name"] for x in told["tfs"]]
        self.own = [[i for i, t in enumerate(self.tfs) if t in x["own"]] for x in told["targets"]]
        self.folds = np.frombuffer(row["folds"], np.uint8)
        m = len(self.folds)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, m)
        self.y = np.frombuffer(row["y"]).reshape(-1, m)
        f = np.frombuffer(row["f"]) if row.get("f") is not None else np.repeat([x["start"] for x in told["targets"]], m)
        f = f.reshape(-1, len(self.y), m)
        self.f = np.repeat(f, models, axis=0) if len(f) < models else f
        self.n, self.yy = (None if row.get(c) is None else np.frombuffer(row[c], t) for c, t in (("n", np.int64), ("yy", np.float64)))
        self.place = {tf: i for i, tf in enumerate(self.tfs)}
        self.past, self.done = past, over

    def left(self, t: int, model: int, eta: float, cells) -> np.ndarray:
        """What the trees so far leave of the values of some cells."""
        f = self.fitted(t, model, eta, cells)
        return self.y[t][cells] - (f if self.n is None else self.n[cells] * f)

    def squares(self, t: int, model: int, eta: float, cells) -> float:
        """Sum of the squares of what is left of single cells."""
        if self.n is None:
            return float(np.square(self.left(t, model, eta, cells)).sum())
        f = self.fitted(t, model, eta, cells)
        return float((self.yy[cells] - f * (2 * self.y[t][cells] - self.n[cells] * f)).sum())

    def count(self, at: np.ndarray, cells, total: int) -> np.ndarray:
        return np.bincount(at, minlength=total) if self.n is None else np.bincount(at, self.n[cells], total).astype(np.int64)

    def codes(self, t: int, width: int) -> np.ndarray | None:
        """A number for each kind of cell of a target; None where they would not fit 62 bits."""
        if 256 * width ** len(self.own[t]) > 1 << 62:
            return None
        code = self.folds.astype(np.int64)
        for i in self.own[t]:
            code = code * width + self.bins[i]
        return code

    def nodes(self, trees: Trees | None, gene: str, model: int) -> np.ndarray:
        """The node each cell is in."""
        node = np.ones(len(self.folds), np.int64)
        for i in trees.of(gene, model) if trees else ():
            at = int(trees.node[i])
            if trees.tf[i] is not None:
                here = np.flatnonzero(node == at) if at > 1 else slice(None)
                node[here] = 2 * at + (self.bins[self.place[trees.tf[i]]][here] > trees.at[i])
        return node

    def fitted(self, t: int, model: int, eta: float, cells=slice(None)) -> np.ndarray:
        """Predictions after the trees so far, of all cells or some."""
        bins = {tf: self.bins[self.place[tf]][cells] for tf in (self.tfs[j] for j in self.own[t])}
        f = self.f[model, t][cells].copy()

        def leaf(tree):
            if not isinstance(tree, tuple):
                return tree
            tf, at, low, high = tree
            return np.where(bins[tf] > at, leaf(high), leaf(low))

        for trees in self.past:
            tree, steps, asked, table = trees.plan(self.targets[t], model, eta)
            if table is None or not asked:
                f += steps[leaf(tree)]
                continue
            told = np.zeros(len(f), np.uint8)
            for i, (tf, at) in enumerate(asked):
                told |= (bins[tf] > at).view(np.uint8) << np.uint8(i)
            f += table[told]
        return f


def _histograms(models: int, level: int, width: int, eta: float, sent=None):
    """``sent`` is a broadcast of (the past trees, the round's tree so far, the targets that have stopped)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, now, over = sent.value if sent else ((), None, frozenset())
        last, sums = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for (gene, model, tf), (g, n) in sums.items():
                at = np.flatnonzero(n)
                out.append(pa.record_batch([pa.array([x] * len(at), t) for x, t in ((gene, pa.string()), (model, pa.int32()), (tf, pa.string()))] + [pa.array(at // width + (1 << level), pa.int32()), pa.array(at % width, pa.int32()), pa.array(g[at]), pa.array(n[at])], names=["gene", "model", "tf", "node", "bin", "g", "n"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last and len(sums) * (width << level) * 16 > HELD_BYTES:
                    yield from flush()
                    sums = {}
                last = row["block"]
                b = _Block(row, models, past, over)
                for t, gene in enumerate(b.targets):
                    if gene in b.done:
                        continue
                    for k in range(models):
                        node = b.nodes(now, gene, k)
                        use = np.flatnonzero((node >= 1 << level) & (b.folds != k))  # no cell is in fold 0
                        if not len(use):
                            continue
                        at, g = (node[use] - (1 << level)) * width, b.left(t, k, eta, use)
                        for j in b.own[t]:
                            key, total = (gene, k, b.tfs[j]), width << level
                            i = at + b.bins[j, use]
                            new = np.bincount(i, g, total), b.count(i, use, total)
                            old = sums.get(key)
                            sums[key] = new if old is None else (old[0] + new[0], old[1] + new[1])
        yield from flush()

    return work


def _errors(models: int, eta: float, sent):
    """Held-out squared errors of each target and fold, once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, over = sent.value
        sums: dict[tuple[str, int], float] = {}
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, models, past, over)
                for k in range(1, models):
                    out = np.flatnonzero(b.folds == k)
                    for t, gene in enumerate(b.targets):
                        if gene not in b.done:
                            sums[gene, k] = sums.get((gene, k), 0.0) + b.squares(t, k, eta, out)
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["gene", "model", "error"])

    return work


def _step(models: int, eta: float, sent):
    """The state with the predictions after the trees so far."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, over = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, models, past, over)
                f = np.zeros((models, *b.y.shape))
                for t, gene in enumerate(b.targets):
                    for k in range(models if gene not in b.done else 0):
                        f[k, t] = b.fitted(t, k, eta)
                new = row | {"f": f.tobytes()}
                yield pa.RecordBatch.from_pylist([new], schema=_schema())

    return work


def best_splits(sums: DataFrame) -> DataFrame:
    """The split of each node with the largest gain over its histograms; ``tf`` is null where none has any."""
    by = ["gene", "model", "node", "tf"]
    upto, all_ = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    s = sums.select(*by, "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(all_).alias("ga"), F.sum("n").over(all_).alias("na"))
    part = lambda g, n: g * g / (n + 1)
    gain = F.round(part(F.col("gl"), F.col("nl")) + part(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")) - part(F.col("ga"), F.col("na")), 9)
    good = F.when((F.col("nl") < F.col("na")) & (gain > 1e-9), F.struct(gain.alias("gain"), F.col("tf"), F.col("bin")))
    best = s.groupBy("gene", "model", "node").agg(F.max_by(F.struct("tf", F.col("bin").alias("at"), gain.alias("gain"), F.col("na").alias("cover"), "gl", "nl"), good).alias("b"), F.max("ga").alias("ga"), F.max("na").alias("na"))
    return best.select("gene", "model", "node", "b.tf", "b.at", "b.gain", "b.cover", "b.gl", "b.nl", "ga", "na")


def best_rounds(errors: DataFrame, patience: int) -> DataFrame:
    """(gene, best, stopped) from (gene, round, rmse): the first of the least errors before ``patience`` rounds in a row are no better."""
    w = Window.partitionBy("gene").orderBy("round")
    x = errors.withColumn("low", F.min("rmse").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("at", F.max(F.when(F.col("low").isNull() | (F.col("rmse") < F.col("low")), F.col("round"))).over(w))
    x = x.withColumn("over", (F.col("round") - F.col("at") >= patience).cast("int"))
    ended = x.groupBy("gene").agg(F.min(F.when(F.col("over") == 1, F.struct("round", "at"))).alias("stop"), F.max(F.struct("round", "at")).alias("last"))
    return ended.select("gene", F.coalesce("stop.at", "last.at").alias("best"), F.col("stop").isNotNull().alias("stopped"))


def boost(expr: DataFrame, motifs: DataFrame, rounds: int = 100, depth: int = 3, eta: float = 0.3, folds: int = 5, patience: int = 10, least_tfs: int = 2, n_bins: int = 32, chunk_cells: int = CHUNK_CELLS) -> tuple[DataFrame, DataFrame]:
    """(links, errors): importance (tf, gene, gain, cover, frequency) of each target's regulators, and (gene, round, rmse, best) of the cross-validation.

    ``folds`` 0 leaves it out; then all ``rounds`` count. Regularisation is 1; a leaf moves by ``eta`` times its mean gradient.
    """
    if not 1 <= n_bins <= 127:
        raise ValueError("n_bins is 1 to 127")
    spark = expr.sparkSession
    good = motifs.where("tf <> gene").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= least_tfs).select("gene")
    some = keep(expr.where("value <> 0").select("gene").distinct())
    links = keep(motifs.where("tf <> gene").select("tf", "gene").distinct().join(good, "gene", "left_semi").join(some, "gene", "left_semi").join(some.withColumnRenamed("gene", "tf"), "tf", "left_semi"))
    models, width = (folds + 1 if folds else 1), 2 * n_bins + 1
    no_links = spark.createDataFrame([], "tf string, gene string, gain double, cover double, frequency double")
    no_errors = spark.createDataFrame([], "gene string, round int, rmse double, best boolean")
    if not links.head(1):
        return no_links, no_errors
    cells = keep(expr.select("cell").distinct())
    state = packed_state(expr, links, n_bins, folds, chunk_cells, cells)
    n_targets = links.select("gene").distinct().count()
    fold_sizes = None
    if folds:
        fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("cell").cast("string")), F.lit(folds)).cast("int") + 1
        fold_sizes = keep(cells.groupBy(fold.alias("model")).agg(F.count("*").alias("n")))
    grown, losses = [], []
    context = spark.sparkContext
    tasks = 2 * context.defaultParallelism
    state = by_kind(state, width, tasks)
    sent = []
    past, over = [], frozenset()  # trees that the written predictions lack, targets that have stopped

    def run(function, schema: str, *told) -> DataFrame:
        """A pass, which the caller writes before the next one."""
        if sent:
            sent.pop().unpersist()
        sent.append(context.broadcast(told))
        return state.coalesce(tasks).mapInArrow(function(sent[0]), schema)

    for r in range(1, rounds + 1):
        splits, now = spark.createDataFrame([], SPLIT), None
        for level in range(depth):
            sums = run(partial(_histograms, models, level, width, eta), HISTOGRAM, past, now, over).repartition("gene")  # the one shuffle of a level
            found = best_splits(sums.groupBy("gene", "model", "tf", "node", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")))
            splits = splits.unionByName(keep(found.where("tf is not null or node = 1")))
            now = Trees(splits.select("gene", "model", "node", "tf", "at", "gl", "nl", "ga", "na").toArrow())
        grown.append(splits.where("model = 0 and tf is not null").withColumn("round", F.lit(r)))
        past = [*past, now]
        if r % WRITE_ROUNDS == 0 and r < rounds:
            state, past = keep(run(partial(_step, models, eta), STATE, past, over)), []
        if not folds:
            continue
        sse = run(partial(_errors, models, eta), "gene string, model int, error double", past, over).groupBy("gene", "model").agg(F.sum("error").alias("sse"))
        rmse = sse.join(fold_sizes, "model").groupBy("gene").agg(F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"))
        losses.append(keep(rmse.select("gene", F.lit(r).alias("round"), "rmse")))
        if r % CHECK_ROUNDS == 0 and r < rounds:
            stopped = best_rounds(_union(losses), patience).where("stopped").select("gene")
            over = frozenset(x["gene"] for x in stopped.collect())
            if len(over) == n_targets:
                break
    stats, ends = _union(grown), no_errors
    if folds:
        best = keep(best_rounds(_union(losses), patience).select("gene", "best"))
        ends = _union(losses).join(best, "gene").select("gene", "round", "rmse", (F.col("round") == F.col("best")).alias("best"))
        stats = stats.join(best, "gene").where(F.col("round") <= F.col("best"))
    each = stats.groupBy("gene", "tf").agg(F.sum("gain").alias("gain"), F.sum("cover").cast("double").alias("cover"), F.count("*").cast("double").alias("frequency"))
    w = Window.partitionBy("gene")
    return each.select("tf", "gene", *((F.col(c) / F.sum(c).over(w)).alias(c) for c in ("gain", "cover", "frequency"))), ends


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
