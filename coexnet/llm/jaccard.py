"""Documents linked by the Jaccard similarity of their word n-gram sets.

The join is a product of the sparse document by n-gram incidence matrix with
its transpose, in blocks, of which only entries that can reach the threshold
are ever computed:

1. One pass hashes each text's n-grams to 64 bits, sorts them, and names the
   set by a hash of it (the *node*; equal sets are one node from here on).
2. Two sets with similarity ``t`` share one of the first
   ``n - ceil(t * n) + 1`` elements in any common order. The order is rare
   n-grams first, by counts over all documents held in a fixed number of
   counters, so n-grams of passages that many documents share come last.
   Each node posts those elements.
3. Runs of equal postings (columns of the incidence matrix) are streamed in
   order of set size; nodes without a neighbour within the size bound
   ``t * n`` are dropped.
4. In a run, parity sketches (one bit per n-gram slot) bound the sets'
   difference from below and discard pairs that cannot reach the threshold. What
   passes is reported as a spanning forest of each run, never as all pairs, and the
   connected parts of it are the row blocks of the product.
5. In a block, rows of the product are accumulated over the members' sparse
   rows: overlaps of one row with all rows within its size bound that
   aren't reached yet. Pairs with enough overlap are links; again a
   spanning forest is kept, so a group of g near copies yields g - 1 links.
6. Components of the links are the result.

Steps 3 and 5 cut runs and blocks of more than ``chunk`` members, or of more than CHUNK_ELEMENTS
elements in their sets, into chunks
that meet pair by pair, which bounds the memory of a task; the work in a
group whose members aren't similar to each other is quadratic in the group,
but no rows are emitted for it. Everything is exact up to collisions
of 64-bit hashes.

Defined cases: null text, or text without words, is an empty set and links
with nothing; fewer words than ``n`` make one n-gram of the whole sequence;
rows that repeat an id are documents of their own; null ids count as larger
than all others (a component of null ids only has a null id); empty
tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import attach, if_small, save, split_words, table, text_slices, unused, word_hashes
from coexnet.llm.graph import connected_components

CHUNK = 4096
COUNTERS = 1 << 22
COUNTER_BLOCKS = 256
CHUNK_ELEMENTS = 1 << 22
SEEN_NODES = 1 << 20
#: A posting whose sketch stands for more elements counts as so many.
SKETCH_ELEMENTS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    owner, codes, names = split_words(texts)
    rows = len(texts)
    w = word_hashes(names)[codes]
    count = np.bincount(owner, minlength=rows)
    ends = np.cumsum(count)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for i in range(n):
            h = _finish(h * _ODD + w[i : i + len(h)])
        out = []
        for a, b in zip(ends - count, ends, strict=True):
            if b - a >= n:
                out.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                x = np.array([b - a], np.uint64)
                for i in range(a, b):
                    x = _finish(x * _ODD + w[i])
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def count_levels(docs: DataFrame, n: int) -> np.ndarray:
    """log2 of the document counts of all n-grams, by the high bits of their hash.

    The result has COUNTERS bytes whatever the input. Tasks add up their own counters and
    send them in blocks; the blocks are summed in a stream.
    """
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in text_slices(batches, "text"):
            sets = ngram_sets(b.column("text"), n)
            if sets:
                total += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=COUNTERS)
        if total.any():
            parts = np.minimum(total, (1 << 31) - 1).astype(np.uint8 if total.max() < 256 else np.int32).reshape(COUNTER_BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                wide = len(x.as_buffer()) > COUNTERS // COUNTER_BLOCKS
                part = np.frombuffer(x.as_buffer(), np.int32 if wide else np.uint8).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        rows = [(k, np.log2(np.maximum(v, 1)).astype(np.uint8).tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "counts"])

    parts = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    levels = np.zeros((COUNTER_BLOCKS, COUNTERS // COUNTER_BLOCKS), np.uint8)
    for r in parts.collect():
        levels[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.ravel()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def most_difference(na, nb, percent: int):
    """The largest symmetric difference that two linked sets of these sizes can have."""
    return (100 - percent) * (na + nb) // (100 + percent)


def parity_sketch(s: np.ndarray, percent: int) -> bytes:
    """A bit per slot: is the number of elements in it odd? Slots are a power of two of at least the set's size, or half of it from 90 percent on.

    Unrelated sets differ in about half the slots, linked ones in at most a tenth (a fifth at 80 percent) of their size.
    """
    bits = max(64, 1 << int(len(s) - 1).bit_length() >> (percent >= 90))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_rows(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, tie, n_shingles, node, tokens, sketch); tokens and sketch only where a task meets a node first."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["tie"]] + [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        level, seen = sent.value, set()
        for b in text_slices(batches, "text"):
            sets = ngram_sets(b.column("text"), n)
            nodes, tokens, sketches = [], [], []
            for s in sets:
                node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                nodes.append(node)
                if node is None or node in seen:
                    tokens.append(None)
                    sketches.append(None)
                    continue
                if len(seen) >= SEEN_NODES:  # later steps drop what repeats
                    seen.clear()
                seen.add(node)
                p = prefix_length(len(s), percent)
                rank = level[(s >> shift).astype(np.int64)]
                cut = np.partition(rank, p - 1)[p - 1]  # s is sorted, so equal levels stay in order of hash
                sure = s[rank < cut]
                tokens.append(np.concatenate([sure, s[rank == cut][: p - len(sure)]]).view(np.int64))
                sketches.append(parity_sketch(s, percent))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=schema.names,
            )

    return save(docs.select("doc_id", "tie", "text").mapInArrow(run, schema), "jaccard-sets")


def shared_postings(postings: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Postings (token, node, n) that have another node of the same token within the size bound, with their chunk.

    Streams each task's rows in order of token and size and holds a few rows only.
    """

    def stream(batches):
        held: list[np.ndarray] | None = None  # the last row met, not yet decided on, and whether it has a partner before it
        partner, place, at = False, 0, None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            token, size, node = cols
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, size, node = token[new], size[new], node[new]
            near = np.zeros(len(token) + 1, bool)  # near[i]: row i - 1 and row i may be linked
            near[0] = partner
            near[1:-1] = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
            keep = np.flatnonzero(near[:-1] | near[1:])
            keep = keep[keep < len(token) - 1]
            if len(keep):
                t = token[keep]
                start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                weight = 1 + size[keep] // SKETCH_ELEMENTS
                pos = np.cumsum(weight) - weight
                pos -= np.repeat(pos[start], np.diff(np.append(start, len(t))))
                if t[0] == at:
                    pos[t == at] += place
                at, place = t[-1], int(pos[-1] + weight[-1])
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(node[keep]), pa.array((pos // chunk).astype(np.int32))], names=["token", "node", "part"])
            held, partner = [x[-1:] for x in (token, size, node)], bool(near[len(token) - 1])
        if held is not None and partner:
            t = held[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[2]), pa.array([place // chunk if t == at else 0], pa.int32())], names=["token", "node", "part"])

    rows = postings.select("token", "size", "node").repartition("token").sortWithinPartitions("token", "size", "node")
    return rows.mapInArrow(stream, "token long, node long, part int")


def meet(rows: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """Rows (key, part, ...) dealt to groups (key, i, j) so that all rows of a key meet, at most two parts a group; (key, last, n) tells the keys with several parts."""
    cut = attach(rows, last, key, "left")
    other = F.explode(F.when(F.col("last").isNull(), F.array(F.col("part"))).otherwise(F.sequence(F.lit(0), F.col("last"))))
    return cut.select("*", other.alias("other")).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("part", "other", "last")


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def sketch_forest(size: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches can't rule out; rows are in order of size."""
    left = list(range(len(size)))
    size = size.tolist()
    bits = [8 * len(s) for s in sketches]
    value = [int.from_bytes(s, "little") for s in sketches]
    halves: dict[tuple[int, int], int] = {}
    edges, queue = [], []
    while left or queue:
        if not queue:
            queue.append(left.pop(0))
        f = queue.pop()
        rest = []
        for k, u in enumerate(left):
            a, b = (f, u) if size[f] <= size[u] else (u, f)
            if 100 * size[a] < percent * size[b]:
                if size[u] > size[f]:
                    rest += left[k:]
                    break
                rest.append(u)
                continue
            to = bits[a]
            if bits[b] != to:
                y = halves.get((b, to))
                if y is None:
                    y = halves[b, to] = _fold(value[b], bits[b], to)
            else:
                y = value[b]
            if (value[a] ^ y).bit_count() <= most_difference(size[a], size[b], percent):
                edges.append((f, u))
                queue.append(u)
            else:
                rest.append(u)
        left = rest
    return edges


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with enough overlap; sets are in order of size.

    Each step is a row of the sparse product: the overlaps of one set with all
    sets within its size bound that no link has reached yet.
    """
    g = len(sets)
    size = np.array([len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    n_columns = int(column.max()) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    rows, live_start, live_column = np.arange(g), start, column
    open_ = np.ones(g, bool)
    edges, queue, mark, first = [], [], np.zeros(n_columns, np.int32), 0
    while True:
        if not queue:
            while first < g and not open_[first]:
                first += 1
            if first == g:
                break
            open_[first] = False
            queue.append(first)
        f = queue.pop()
        alive = open_[rows]
        if not alive.any():
            continue
        if 2 * alive.sum() < len(rows):  # drop the rows already reached
            live_column = live_column[np.repeat(alive, np.diff(live_start))]
            rows = rows[alive]
            live_start = np.concatenate([[0], np.cumsum(size[rows])])
        lo = np.searchsorted(100 * size[rows], percent * size[f], side="left")
        hi = np.searchsorted(percent * size[rows], 100 * size[f], side="right")
        if lo >= hi:
            continue
        mine = column[start[f] : start[f + 1]]
        mark[mine] = 1
        part = mark[live_column[live_start[lo] : live_start[hi]]]
        overlap = np.add.reduceat(part, live_start[lo:hi] - live_start[lo])
        mark[mine] = 0
        near = rows[lo:hi][100 * overlap >= percent * (size[f] + size[rows[lo:hi]] - overlap)]
        near = near[open_[near]]
        open_[near] = False
        edges += [(f, int(u)) for u in near]
        queue += near.tolist()
    return edges


def _forest_rows(rows: DataFrame, key: str, payload: str, forest) -> DataFrame:
    """(a, b) of ``forest(payloads, sizes)`` over each group (key, i, j) of rows (key, i, j, size, node, payload)."""

    def run(batches):
        now, nodes, sizes, values = None, [], [], []

        def edges():
            if len(nodes) < 2:
                return []
            return [(nodes[x], nodes[y]) for x, y in forest(sizes, values)]

        for b in batches:
            out = []
            keys = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            for k, s, node, v in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if k != now:
                    out += edges()
                    now, nodes, sizes, values = k, [], [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    sizes.append(s)
                    values.append(v.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := edges():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    dealt = rows.select(key, "i", "j", "size", "node", payload).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "size", "node")
    return dealt.mapInArrow(run, "a long, b long")


def linked_nodes(docs: DataFrame, sets: DataFrame, n: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of all nodes that have a link."""
    first = sets.where("tokens is not null")
    postings = first.select(F.explode("tokens").alias("token"), F.col("n_shingles").cast("int").alias("size"), "node")
    shared = save(shared_postings(postings, percent, chunk), "jaccard-postings")
    sketches = first.select("node", F.col("n_shingles").cast("int").alias("size"), "sketch").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    last = shared.groupBy("token").agg(F.max("part").alias("last"), F.count("*").alias("n")).where("last > 0")
    candidates = _forest_rows(meet(shared, last, "token").join(sketches, "node"), "token", "sketch", lambda size, sk: sketch_forest(np.array(size), sk, percent))
    blocks = save(connected_components(candidates), "jaccard-blocks")

    ids = sets.join(blocks.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct().withColumnRenamed("doc_id", "__id")
    ids = if_small(save(ids, "jaccard-members"))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def member_sets(batches):
        for b in text_slices(batches, "text"):
            found = [(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), len(s), s.tobytes()) for s in ngram_sets(b.column("text"), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["node", "size", "set"])

    members = texts.select("text").mapInArrow(member_sets, "node long, size int, set binary")
    sized = blocks.join(sketches.select("node", "size"), "node")
    place = if_small(save(_block_places(sized, chunk), "jaccard-places"))
    rows = members.join(place, "node")
    links = _forest_rows(rows, "root", "set", lambda _, sets: link_forest([np.frombuffer(s, np.uint64) for s in sets], percent))
    return save(connected_components(links), "jaccard-components")


def _block_places(blocks: DataFrame, chunk: int) -> DataFrame:
    """(root, node, i, j): the nodes (node, root, size) of a block in parts of about ``chunk`` members and CHUNK_ELEMENTS elements, by a hash of the node, dealt to pairs of parts."""
    blocks = save(blocks, "jaccard-sized")
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / CHUNK_ELEMENTS)).cast("int")
    last = save(blocks.groupBy("root").agg((parts - 1).alias("last"), F.count("*").alias("n")).where("last > 0"), "jaccard-large")
    cut = attach(blocks.select("root", "node"), last, "root", "left")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("other")
    part = F.pmod(F.xxhash64("node"), F.coalesce("last", F.lit(0)) + 1).cast("int").alias("part")
    return cut.select("root", "node", part, other).select("root", "node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, tie, n_shingles, node, root, component_id) for every row of ``docs``.

    tie is a hash of the text, root names the component (null for an empty set); component_id is its smallest id.

    Documents link when ``100 * overlap >= percent * union`` of their ``n``-gram sets.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    sets = set_rows(docs, n, percent, count_levels(docs, n))
    roots = linked_nodes(docs, sets, n, percent, chunk)
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = save(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-nodes")
    component = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = attach(joined.select("node", "root"), component, "root").select("node", "root", "component_id")
    out = sets.select("doc_id", "tie", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "tie", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` (all columns) with one row of each component: that with the smallest id, then text hash.

    Rows with no words are no copies of each other and all stay; of rows equal in id and text one stays if they have words.
    """
    found = save(jaccard_components(docs, n, percent, id_col, text_col, chunk).where("node is not null"), "jaccard-found")
    # ids may be null or repeat in other components, so the root tells components apart and the least (id, text) pair decides
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("k"))
    kept = save(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.tie").alias("kept_tie")), "jaccard-kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tie") == F.col("kept_tie"))
    a, b, t = unused(docs, "__id", "__tie", "__text_tie")
    gone = found.select("doc_id", "tie").distinct().join(kept, same, "left_anti").select(F.col("doc_id").alias(a), F.col("tie").alias(b))
    gone = if_small(save(gone, "jaccard-gone"))
    out = docs.withColumn(t, F.xxhash64(text_col))
    out = out.join(gone, F.col(id_col).eqNullSafe(F.col(a)) & (F.col(t) == F.col(b)), "left_anti")
    again = found.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count()
    if again:  # equal rows: one of each stays
        worded = F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
        out = out.where(worded).dropDuplicates([id_col, t]).unionAll(out.where(~worded))
    return out.drop(t)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at similarity 0.9 of 3-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op10_jaccard": r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                             ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
n AS (SELECT r, doc_id, len(sh) AS n FROM s),
x AS (SELECT r, unnest(sh) AS g FROM s),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT ra, rb FROM p JOIN n na ON na.r = ra JOIN n nb ON nb.r = rb WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT ra AS a, rb AS b FROM l UNION ALL SELECT rb, ra FROM l),
c AS (SELECT r, r AS at FROM n UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.at)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(m.doc_id) AS component_id
FROM n JOIN c ON c.r = n.r JOIN n m ON m.r = c.at GROUP BY n.r, n.doc_id, n.n"""
}
