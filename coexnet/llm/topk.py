"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates and queries meet in blocks: a group holds about ``candidate_rows``
candidates and ``query_rows`` queries at most, so memory is bounded and the work is
spread over all (candidate block, query block) pairs. In a group the
candidates are sorted once per dimension, for all its queries. A query walks the lists
from the top where its component is positive and from the bottom where
it is negative; the rows met are scored in full. The bound on every row not
met so far is the sum of the query's components times the values where its
walks stand, so in each round those lists go on that lower this sum most. The walk ends
when the bound is below the k-th best score (equal
bounds go on, for a smaller id may still win a tie). Rounds grow in length, so that
each is a few array operations.

Every query first meets one block only. The k-th best score there is a bound from
below on its k-th best of all, from which the walks in all blocks
start: they end earlier, and only rows that reach it leave a group. Those meet
in a window, k a block and query at most.

How much is pruned is up to the data: on vectors without a direction of their own
(independent components, tens of dimensions) no bound on sums of lists falls below the
k-th score before nearly all rows are met. ``with_scored`` reports the
share.

Defined cases: rows with a null id, a null vector, or null, NaN or infinite
components take no part; vectors of unequal length are padded with zeros,
which leaves inner products as they are; rows that repeat an id are
candidates each, and the candidates that share the query's id are not its
answers; equal queries are asked once; equal scores rank by id; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coexnet.llm.common import save, table

CANDIDATE_ROWS = QUERY_ROWS = 1 << 15
LEAST_ROWS = 2048


def sorted_lists(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per dimension, the rows by descending value (dims x rows)."""
    by_id = np.argsort(ids, kind="stable").astype(np.int32)
    return np.stack([by_id[np.argsort(-x[by_id, d], kind="stable")] for d in range(x.shape[1])]) if x.shape[1] else np.empty((0, len(x)), np.int32)


def threshold_topk(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, k: int, own, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, rows scored) of the k best rows for ``q`` whose id isn't ``own``; rows below ``least`` may be missing."""
    n = len(x)
    dims = np.flatnonzero(q)
    if not len(dims):  # every score is 0: the smallest ids win
        order = np.argsort(ids, kind="stable")
        rows = order[ids[order] != own][:k]
        return rows, np.zeros(len(rows), x.dtype), 0
    weight, up = q[dims].astype(np.float64), q[dims] > 0
    at = lambda pos: weight * x[lists[dims, np.where(up, pos, n - 1 - pos)], dims]
    unseen = np.ones(n, bool)
    best, score = np.empty(0, np.int64), np.empty(0, x.dtype)
    depth, step, scored = np.zeros(len(dims), np.int64), max(1, n // 256), 0
    front = at(depth)
    while True:
        ahead = np.minimum(depth + step, n) - 1
        reach = at(ahead)
        drop = front - reach
        pick = np.flatnonzero((drop > 0) & (2 * drop >= drop.max()))
        if not len(pick):  # level stretches of all lists
            pick = np.arange(len(dims))
        met = np.zeros(n, bool)
        for i in pick:
            line = lists[dims[i]]
            met[line[depth[i] : ahead[i] + 1] if up[i] else line[n - 1 - ahead[i] : n - depth[i]]] = True
        depth[pick], front[pick] = ahead[pick] + 1, reach[pick]
        new = np.flatnonzero(met & unseen)
        unseen[new] = False
        scored += len(new)
        rows = np.concatenate([best, new[ids[new] != own]])
        s = np.concatenate([score, x[rows[len(best) :]] @ q])
        if len(rows) > k:  # all that reach the k-th score, then the smaller ids
            keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            keep = keep[np.lexsort((ids[rows[keep]], -s[keep]))][:k]
            rows, s = rows[keep], s[keep]
        best, score = rows, s
        if scored == n or front.sum() < (max(least, score.min()) if len(best) == k else least):
            break
        depth = np.minimum(depth, n - 1)
        step = -(-3 * step // 2)
    order = np.lexsort((ids[best], -score))
    return best[order], score[order], scored


def _search(k: int, lowest_only: bool):
    """The search of one group (block, ask): rows (query_id, q, vec_id, score, scored); a row of each query with a null vec_id tells the rows scored, or with ``lowest_only`` just the k-th score."""

    def search(group: pa.Table) -> pa.Table:
        ids, ask, number = group["id"].to_numpy(), group["is_query"].to_numpy(), group["q"].to_numpy()
        floor = group["least"].combine_chunks().fill_null(-(1 << 62)).to_numpy().astype(np.float64)
        v = group["v"].combine_chunks()
        offsets = v.offsets.to_numpy()
        length = np.diff(offsets)
        dims = int(length.max(initial=0))
        x = np.zeros((len(ids), dims))
        x[np.repeat(np.arange(len(ids)), length), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], length)] = v.flatten().to_numpy()
        if np.abs(x).max(initial=0) ** 2 * dims < 1 << 24:
            x = x.astype(np.float32)  # still exact
        rows, rid = np.ascontiguousarray(x[~ask]), ids[~ask]
        lists = sorted_lists(rows, rid)
        out: list[tuple] = []
        for own, n, q, least in zip(ids[ask].tolist(), number[ask].tolist(), x[ask], floor[ask], strict=True):
            at, s, scored = threshold_topk(rows, rid, lists, q, k, own, least) if len(rows) else (np.empty(0, np.int64), np.empty(0), 0)
            if lowest_only:
                out += [(own, n, None, int(s[-1]), scored)] if len(s) == k else []
            else:
                out += [(own, n, i, int(z), None) for i, z in zip(rid[at].tolist(), s, strict=True) if z >= least] + [(own, n, None, None, scored)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 5)], names=["query_id", "q", "vec_id", "score", "scored"])

    return search


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector",
    candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, with_scored: bool = False,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of ``vectors`` with the largest inner products for each query.

    Both frames hold a long id and an array of longs. Scores are exact while
    ``dims * max^2`` is below 2^53. ``with_scored`` adds scored and candidates: how many rows were scored for the query, of how many.
    """
    spark = vectors.sparkSession
    good = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)")
    base, asked = save(good(vectors), "topk-rows"), save(good(queries).distinct().withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    n_base, n_asked = base.count(), asked.count()
    # small tables are cut finer, to have a block for each core
    blocks = max(1, -(-n_base // candidate_rows), min(n_base // LEAST_ROWS, spark.sparkContext.defaultParallelism))
    asks = max(1, -(-n_asked // query_rows))
    spread = lambda parts, *by: F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    # a vector that fills a third of the rows has as many ids; rows that are equal in both are dealt by position
    base = base.withColumn("block", spread(blocks, F.col("id"), F.monotonically_increasing_id()))
    as_base = lambda df: df.select("block", "ask", F.lit(False).alias("is_query"), F.lit(-1).cast("long").alias("q"), "id", "v", F.lit(None).cast("long").alias("least"))
    as_query = lambda df: df.select("block", "ask", F.lit(True).alias("is_query"), "q", "id", "v", "least")
    schema = "query_id long, q long, vec_id long, score long, scored long"
    asked = asked.withColumn("least", F.lit(None).cast("long"))
    if blocks > 1:
        one = asked.withColumns({"block": spread(blocks, F.col("q")), "ask": F.lit(0)})
        first = as_base(base.withColumn("ask", F.lit(0))).unionAll(as_query(one)).groupBy("block", "ask").applyInArrow(_search(k, True), schema)
        asked = save(asked.drop("least").join(first.select("q", F.col("score").alias("least")), "q", "left"), "topk-floors")
    c = base.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    q = asked.withColumn("ask", spread(asks, F.col("q"), F.lit(2))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = as_base(c).unionAll(as_query(q)).groupBy("block", "ask").applyInArrow(_search(k, False), schema)
    if with_scored:
        found = save(found, "topk-found")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.where("vec_id is not null").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if with_scored:
        share = found.where("vec_id is null").groupBy("query_id").agg(F.sum("scored").alias("scored"))
        out = out.join(share, "query_id").withColumn("candidates", F.lit(n_base).cast("long"))
    return out


def quantise(vector, scale: int = 256):
    """floor(scale * x) of each component, null if the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector against all others."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("vector"))
    return exact_topk(v, v.where(F.col("vec_id") % 50 == 0), 5)


SQL = {
    "op3_topk": """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
