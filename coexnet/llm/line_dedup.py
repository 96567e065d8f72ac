"""Lines repeated across documents, found by hashes and told as keep bitmaps.

A line's key is the line stripped at both ends and lower-cased (A-Z). Keys of at least ``min_chars``
code points that ``min_docs`` documents or more hold lose all their lines but those of the largest id.
Only (key hash, id, position) rows are shuffled: they are range-partitioned by hash and sorted by document,
largest first, and position, so that the first occurrence of a key meets the stream before all others.
The result is a bitmap for each document that loses lines, compressed to the runs of its zeros; texts
stay where they are until ``apply_keep`` cuts them.

A key with very many lines is cut into slices by document. Such keys number 65,536 at most, so the few facts about
them (their documents, the largest id) are broadcast.

Defined cases: a null text is one empty line; a null id is a document below all others; rows that repeat an id are one
document, which counts once and loses or keeps the line in every row; an empty table gives no rows; keys are told apart by
128 bits of hash, texts of one id by 64. Extra columns pass through ``apply_keep``, those named as its outputs are replaced.
Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coexnet.llm.common import HOT_KEYS, HOT_ROWS, save, table

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_mark(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, mark, pos) of every line whose key has ``min_chars`` code points; ``pos`` counts all lines from 0."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), text_mark(text).alias("mark"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "mark", "pos")


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, mark, pos) of the lines to drop."""
    rows = save(hashes, "line-hashes")
    key = ["h1", "h2"]
    many = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))
    hot = save(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > many).select(*key, F.ceil(F.col("n") / many).cast("int").alias("slices")), "line-hot")
    any_hot, cut = hot.head(1), key
    if any_hot:
        rows, cut = rows.join(F.broadcast(hot), key, "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("slices")), F.lit(0)).cast("int")).drop("slices"), [*key, "slice"]
    ranged = rows.repartitionByRange(*cut)
    group = Window.partitionBy(*cut)  # the ranges hold it: no second shuffle
    stream = group.orderBy(F.col("doc").desc_nulls_last(), "mark", "pos")
    first = F.row_number().over(stream) == 1
    seen = ranged.withColumn("new", (first | ~F.col("doc").eqNullSafe(F.lag("doc").over(stream))).cast("int"))
    seen = seen.withColumns({"top": F.first("doc").over(stream), "docs": F.sum("new").over(group)})
    if any_hot:
        each = seen.join(F.broadcast(hot), key).where("new = 1").groupBy(*key).agg(F.count("*").alias("all_docs"), F.max("doc").alias("all_top"))
        facts = save(each, "line-facts")  # a row for each of the keys above
        seen = seen.join(F.broadcast(facts), key, "left")
        seen = seen.withColumns({"top": F.when(F.col("all_docs").isNull(), F.col("top")).otherwise(F.col("all_top")), "docs": F.coalesce("all_docs", "docs")})
    return seen.where((F.col("docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "mark", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, mark, n_dropped, zeros): the runs (start, length) of zeros in each document's keep bitmap, all other bits being one."""
    place = Window.partitionBy("doc", "mark").orderBy("pos")
    runs = dropped.withColumn("run", F.col("pos") - F.dense_rank().over(place)).groupBy("doc", "mark", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    run = F.struct("start", (F.col("last") - F.col("start") + 1).alias("length"))
    return runs.groupBy("doc", "mark").agg(F.sum(F.col("last") - F.col("start") + 1).alias("n_dropped"), F.sort_array(F.collect_list(run)).alias("zeros"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines (before), n_dropped and kept_text."""
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("n_dropped").alias("__dropped"), F.col("zeros").alias("__zeros"))
    both = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__doc")) & (text_mark(F.col(text_col)) == F.col("__mark")), "left")
    lines, zeros = lines_of(F.col(text_col)), F.col("__zeros")

    def ones(j):
        before, after = F.get(zeros, j - 1), F.get(zeros, j)
        start = F.coalesce(before["start"] + before["length"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(after["start"], F.size(lines)) - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(zeros)), ones)), "\n")
    out = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("__dropped", F.lit(0)).cast("long"), "kept_text": F.when(zeros.isNull(), F.coalesce(text_col, F.lit(""))).otherwise(kept)}
    return both.withColumns(out).drop("__doc", "__mark", "__dropped", "__zeros")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keep bitmaps of ``docs``: see ``keep_bitmaps``."""
    return keep_bitmaps(repeated_lines(line_hashes(docs, id_col, text_col, min_chars), min_docs))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a later document of five or more repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = apply_keep(docs, dedup_lines(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.top AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid"""
}
