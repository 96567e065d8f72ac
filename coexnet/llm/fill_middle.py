"""Fill-in-the-middle: texts cut into prefix, middle and suffix at line ends and put in another order.

DuckDB works on whole Arrow batches inside ``mapInArrow``: each batch is registered as a view and one SQL statement
makes all columns. A text is a list of ``n`` units (lines with their line feed); two cuts drawn from the SHA-256 of seed and id
part it. With the forms ``psm`` and ``spm`` the parts follow markers:

    psm: <P> prefix <S> suffix <M> middle        spm: <S> suffix <P> prefix <M> middle

A text that is empty or holds a marker stays plain, as does the share that isn't drawn. ``restored`` is read back from
output and form alone. A batch is cut so that its texts stay near ``slice_bytes``; one longer text is a slice of its own.

Defined cases: a null text is an empty one; a null id counts as an empty string; repeated rows give equal rows; an empty
table gives no rows. Only the named columns are read, so further columns (whatever their names) don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from coexnet.llm.common import table, text_slices

MARKS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
SLICE_BYTES = 8 << 20


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fim_sql(seed: int | str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> str:
    """DuckDB SQL for (doc_id, n, form, prefix_chars, middle_chars, output, restored) of a view ``batch`` (doc_id, text)."""
    p, s, m = map(_quoted, marks)
    draw = lambda k: f"CAST('0x' || substr(hex, {8 * k + 1}, 8) AS UBIGINT)"
    after = lambda part, mark: f"substr({part}, strpos({part}, {mark}) + {{n}})"
    tail = {x: after("output", q).format(n=len(x)) for x, q in zip(marks, (p, s, m), strict=True)}
    upto = lambda part, mark: f"substr({part}, 1, strpos({part}, {mark}) - 1)"
    psm = f"{upto(tail[marks[0]], s)} || {tail[marks[2]]} || {upto(tail[marks[1]], m)}"
    spm = f"{upto(tail[marks[0]], m)} || {tail[marks[2]]} || {upto(tail[marks[1]], p)}"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_quoted(f"{seed}:")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM batch),
units AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM texts),
cuts AS (SELECT *, len(u) AS n, {draw(0)} % (len(u) + 1) AS c1, {draw(1)} % (len(u) + 1) AS c2,
           CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {fim_percent} THEN 'plain'
                WHEN {draw(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, text, n, form, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS prefix,
           array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
           array_to_string(list_slice(u, greatest(c1, c2) + 1, n), '') AS suffix FROM cuts),
made AS (SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parts)
SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {psm} ELSE {spm} END AS restored FROM made"""


def _run(sql: str, schema: pa.Schema, slice_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for piece in text_slices(batches, "text", slice_bytes):
                db.register("batch", pa.table([piece.column("doc_id"), piece.column("text")], names=["doc_id", "text"]))
                yield from db.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches()
                db.unregister("batch")

    return work


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS, digests: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars) and the texts output and restored, or with ``digests`` their SHA-256 in their place."""
    if any(not x for x in marks) or len(set(marks)) < 3:
        raise ValueError("three different marks are wanted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sql, names = fim_sql(seed, fim_percent, spm_percent, marks), ["output", "restored"]
    if digests:
        names = ["output_sha256", "restored_sha256"]
        sql = f"SELECT * EXCLUDE (output, restored), sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({sql})"
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *((x, pa.string()) for x in names)]
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), *fields])
    return rows.mapInArrow(_run(sql, schema, slice_bytes), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {names[0]} string, {names[1]} string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-the-middle form, told by digests."""
    return fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


SQL = {
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM d),
f AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
             list_aggregate(u[:least(a, b)], 'string_agg', '') AS p, list_aggregate(u[least(a, b) + 1:greatest(a, b)], 'string_agg', '') AS m FROM c),
x AS (SELECT doc_id, n, form, t, coalesce(p, '') AS p, coalesce(m, '') AS m, t[len(coalesce(p, '')) + len(coalesce(m, '')) + 1:] AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x"""
}
