"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document of a source gets the key ``-ln(u) / weight`` with ``u`` a fixed
hash of seed and id in (0, 1): smallest keys first is a weighted order
without replacement. A source whose target is ``e`` times its size and a rest
takes every document ``e`` times (complete epochs), then walks that order and
takes documents while their summed sizes stay within the rest; the document
at the boundary is taken whole if that ends nearer to the rest.

The walk needs no sort of a whole source: keys fall into ranges of equal ratio,
``RANGES`` for each factor e. Whatever the weights, the logarithm of an exponential key has a density of at most 1/e, so
a range is expected to hold no more than ``1 / (e * RANGES)`` of the rows, 0.15 %. Sums per (source, range) are combined
before the shuffle, and only the one range per source that holds the boundary is put in order. A source
with a third of all rows is therefore spread over all tasks. Sources may be as many
as hosts: their order, their turn in the cycle of weights and the sums behind their
targets come from prefix sums over range partitions, so no task holds them all.

Defined cases: null source is a source of its own and sorts last; null text
has size 0; null, NaN or non-positive weights count as the least weight;
rows that repeat an id are ordered by size, then by a hash of the text; an empty table
gives no rows; a source of size 0 has target 0 and takes nothing. Extra
columns pass through ``mix`` untouched unless they clash with its outputs,
which then replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coexnet.llm.common import save, table

RANGES = 256
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
LEAST_WEIGHT = 0.05
SEED = "mix-1"
SIGNS = r"[0-9!#$%&*|_=~^<>{}\[\]@\\/+]"
GAP = r"[\x20\x09-\x0D]+"


def sampling_key(id_col, weight, seed: str = SEED):
    """Exponential key; 52 hash bits give u, so the order is the same on every engine and run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / F.lit(float(1 << 52))
    w = F.greatest(F.coalesce(F.nanvl(weight, F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    return -F.log(u) / w


def key_range(key):
    """Number of a key's range; ranges are in the order of keys."""
    return F.floor(F.log(key) * RANGES).cast("int")


def running_sums(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows before and up to each one in ``order``, which is total.

    Sums run inside range partitions; the partitions' totals, one row each, move them up.
    """
    dealt = save(rows.repartitionByRange(*order).withColumns({"part": F.spark_partition_id(), **{f"{k}_one": c for k, c in sums.items()}}), "mix-order")
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*(F.sum(f"{k}_one").alias(k) for k in sums))  # a row for each partition
    offset = totals.select("part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    return dealt.join(offset, "part").withColumns({k: F.col(f"{k}_before") + F.sum(f"{k}_one").over(upto) for k in sums}).drop("part", *(f"{k}_{x}" for k in sums for x in ("one", "before")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size), one row a source.

    The reshared targets are ``min(cap * size, level * weight)`` for one common
    level. Sorted by ``cap * size / weight``, the capped sources are a prefix;
    the level if the first k are capped rises up to the right k and falls
    after it, so it is the largest of these; no loop over reshares is needed.
    """
    s = running_sums(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("source_size").cast("double"))
    s = running_sums(s, [F.col("most") / F.col("w"), F.col("source").asc_nulls_last()], {"capped": F.col("most"), "w_upto": F.col("w")})
    s = save(s, "mix-sources")
    everything = s.agg((share * F.sum("source_size").cast("double")).alias("budget"), F.sum("w").alias("w_all"))
    before, w_from = F.col("capped") - F.col("most"), F.col("w_all") - F.col("w_upto") + F.col("w")
    level = s.crossJoin(F.broadcast(everything)).agg(F.max((F.col("budget") - before) / w_from).alias("level"))  # both are one row
    s = s.crossJoin(F.broadcast(level))
    s = s.withColumn("target", F.when(F.col("most") == 0, 0.0).otherwise(F.coalesce(F.least("most", F.col("w") * F.col("level")), F.col("most"))))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, weight, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` reduced to (id, size, source, source_size, target, taken); ``weight`` is a column of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"),
        sampling_key(F.col(id_col), weight.cast("double"), seed).alias("key"), F.xxhash64(F.col(text_col)).alias("tie"),
    )
    rows = save(rows.withColumn("bucket", key_range(F.col("key"))), "mix-rows")
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target", "epochs", "rest")
    walk = Window.partitionBy("source").orderBy("bucket")
    edge = (
        ranges.withColumn("before", F.sum("words").over(walk) - F.col("words"))
        .join(named, F.col("source").eqNullSafe(F.col("t_source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .groupBy("t_source").agg(F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("before"))
    )
    plan = named.join(edge.withColumnRenamed("t_source", "e_source"), F.col("t_source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    plan = save(plan, "mix-plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # a source without an edge is taken whole up to its rest, that is never: its rest is below its size
    inside = joined.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("extra", (F.col("edge").isNotNull() & (F.col("bucket") < F.col("edge"))).cast("long"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie")
    end = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = joined.where(F.col("bucket") == F.col("edge")).withColumn("end", end)
    start = F.col("end") - F.col("size")
    at = at.withColumn("extra", ((F.col("end") <= F.col("rest")) | ((start <= F.col("rest")) & (F.col("end") - F.col("rest") < F.col("rest") - start))).cast("long"))
    out = inside.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra").unionAll(at.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"))


def words_of(text):
    """The words of a text; written once, so that its users in a plan share it."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def text_weight(text):
    """Quality weight of a text, 0 to 1: clean characters times new words times new lines; 0 if empty.

    Clean is the share of characters that aren't digits or signs; new words are the
    distinct among all, which long texts reach less, so their root counts; new lines are the distinct among all.
    """
    words, lines = words_of(text), F.split(text, "\n")
    clean = 1 - F.regexp_count(text, F.lit(SIGNS)) / F.nullif(F.length(text), F.lit(0))
    fresh = lambda parts: F.size(F.array_distinct(parts)) / F.nullif(F.size(parts), F.lit(0))
    return F.coalesce(clean * F.sqrt(fresh(words)) * fresh(lines), F.lit(0.0))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighted 5, 2, 1."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, text_weight(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op2_mix": r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce((1 - len(regexp_extract_all(text, '[0-9!#$%&*|_=~^<>{}\[\]@\\/+]')) / nullif(length(text), 0)::DOUBLE)
           * sqrt(len(list_distinct(ws)) / nullif(len(ws), 0)::DOUBLE) * (len(list_distinct(ls)) / nullif(len(ls), 0)::DOUBLE), 0.0) AS q,
         (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, -ln(u) / greatest(q, 0.05) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
             2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS budget FROM s),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
l AS (SELECT *, max((budget - capped) / w_from) OVER () AS level FROM c),
t AS (SELECT source, source_size, CAST(CASE WHEN most = 0 THEN 0.0 ELSE coalesce(least(most, w * level), most) END AS DOUBLE) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) AS fin
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((epochs + CASE WHEN fin <= rest OR (fin - size <= rest AND fin - rest < rest - (fin - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r"""
}
