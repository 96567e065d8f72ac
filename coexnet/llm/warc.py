"""WARC archives through a chunked record table.

A payload never leaves the scan as one value: there it is cut into a run of rows ``(row_no, chunk_no,
data)`` of at most ``chunk_bytes`` each, which stream through a task that adds to every row the SHA-256 of
the payload up to and including its chunk. Writing sorts those rows and
streams them into gzip members; reading inflates an archive block by block
and yields such rows again. Neither side allocates a whole record.

Records: ``response`` holds an HTTP head and the payload; ``revisit`` holds
the HTTP head only (its Content-Length still tells the payload's size), the
payload digest, and the id of the response that it repeats. Of records with
equal payloads of at least ``min_revisit_bytes`` the smallest id is the
response.

Defined cases: a null payload is an empty one; a null id sorts after all
others, so it never is the response while an id is there; rows that repeat
the smallest id of a payload are all responses; a null URI leaves the field
out, and control characters in it are percent-encoded; an empty table gives
no archive and no rows. Only the named columns are read, so further columns
(whatever their names) don't matter.

An archive's name holds the task attempt that wrote it, and the manifest lists
the archives of successful attempts only: what a lost executor left is
never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coexnet.llm.common import new_path, save, table

CHUNK_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 100
ID_SCHEME = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(column):
    return F.coalesce(column.cast("binary"), F.lit(bytearray()))


def payload_facts(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(rid, payload_bytes, digest) of every row."""
    payload = _payload(F.col(payload_col))
    return df.select(F.col(id_col).alias("rid"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"))


def chunk_table(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``df``.

    Columns: row_no (tells rows apart), rid, uri, chunk_no (from 0), data,
    payload_bytes and digest (of the whole payload), running_digest (SHA-256 up to this chunk).
    An empty payload has one empty chunk.
    """
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    whole = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("rid"), uri.alias("uri"), _payload(F.col(payload_col)).alias("payload"))
    whole = whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha2("payload", 256))})
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes), F.lit(1)).cast("int") - 1
    cut = whole.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    cut = cut.select("row_no", "rid", "uri", "chunk_no", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"), "payload_bytes", "digest")

    def running(batches):
        h = hashlib.sha256()
        for b in batches:  # chunks follow each other as they were cut
            out = []
            for k, data in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                h = hashlib.sha256() if k == 0 else h
                h.update(data.as_buffer())
                out.append(h.digest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "running_digest"])

    return cut.mapInArrow(running, T.StructType([*cut.schema, T.StructField("running_digest", T.BinaryType())]))


def revisit_plan(facts: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(rid, digest, refers_to) once for each id and payload; refers_to is null for a response.

    The smallest id of a payload comes from a grouped minimum (combined before
    the shuffle); handing it back is a plain join of narrow rows that adaptive
    execution splits where one payload fills a large share of the table.
    """
    first = facts.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min("rid").alias("first"))
    each = facts.select("rid", "digest").distinct()
    other = ~F.col("first").eqNullSafe(F.col("rid")) & F.col("first").isNotNull()
    return each.join(first, "digest", "left").select("rid", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record_uri(rid) -> str:
    return f"<{ID_SCHEME}{'' if rid is None else quote(str(rid), safe='')}>"


class _Archives:
    """Writes one task's records into archives of about ``archive_bytes``, a gzip member each."""

    def __init__(self, folder: str, stem: str, date: str, archive_bytes: int, level: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.stem, self.date, self.most, self.level = folder, stem, date, archive_bytes, level
        self.out, self.done, self.seq = None, [], 0

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def begin(self, head: bytes) -> None:
        if self.out is None or self.size >= self.most:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{self.stem}-{self.seq:04d}.warc.gz"
            self.out, self.size, self.records, self.seq = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0, self.seq + 1
            info = b"format: WARC File Format 1.1\r\n"
            self._member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{self.name}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info)
        self.gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.add(head)

    def _member(self, data: bytes) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(gz.compress(data + b"\r\n\r\n") + gz.flush())

    def add(self, data: bytes) -> None:
        if packed := self.gz.compress(data):
            self._put(packed)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self.gz.flush())
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, self.size))
            self.out = None


def write_warc(
    df: DataFrame, folder: str, id_col: str, payload_col: str, uri_col: str | None = None,
    min_revisit_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 4,
) -> DataFrame:
    """Write a record per row of ``df`` into archives under ``folder``; returns the manifest (path, records, bytes).

    Chunks of responses meet the plan in one shuffle keyed by id and digest,
    which no hot payload skews; revisits send no data at all.
    """
    plan = revisit_plan(payload_facts(df, id_col, payload_col), min_revisit_bytes).select(F.col("rid").alias("p_rid"), F.col("digest").alias("p_digest"), "refers_to")
    chunks = chunk_table(df, id_col, payload_col, uri_col, chunk_bytes)
    joined = chunks.join(plan, (F.col("digest") == F.col("p_digest")) & F.col("rid").eqNullSafe(F.col("p_rid")))
    rows = joined.where(F.col("refers_to").isNull() | (F.col("chunk_no") == 0)).select(
        "row_no", "chunk_no", "rid", "uri", "payload_bytes", F.hex("digest").alias("digest"), "refers_to", F.when(F.col("refers_to").isNull(), F.col("data")).alias("data")
    )

    def write(batches):
        task = TaskContext.get()
        to = _Archives(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}", date, archive_bytes, level)
        left = -1
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            meta = zip(*(cols[n].to_pylist() for n in ("chunk_no", "rid", "uri", "payload_bytes", "digest", "refers_to")), strict=True)
            for (chunk_no, rid, uri, size, digest, refers), data in zip(meta, cols["data"], strict=True):
                if chunk_no == 0:
                    http = _http(size)
                    kind = "response" if refers is None else "revisit"
                    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_uri(rid)), ("WARC-Date", date), ("WARC-Target-URI", uri if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))]
                    fields += [("WARC-Payload-Digest", f"sha256:{digest.lower()}")]
                    if refers is not None:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers))]
                    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (size if refers is None else 0)))]
                    to.begin(_header(fields) + http)
                    left = size if refers is None else 0
                if refers is None and data.is_valid:
                    part = memoryview(data.as_buffer())
                    to.add(part)
                    left -= len(part)
                if left == 0:
                    to.end()
                    left = -1
        to.close()
        names = ["path", "records", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*to.done) if to.done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)

    return save(rows.sortWithinPartitions("row_no", "chunk_no").mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class _Inflated:
    """Bytes of a multi-member gzip file, a bounded piece at a time."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece, self.raw, self.buf, self.gz = stream, piece, b"", bytearray(), None

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    return False
            if self.gz is None:
                self.gz = zlib.decompressobj(31)
            data = self.gz.decompress(self.raw, self.piece)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = None
            if data:
                self.buf += data
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        seen = 0
        while (at := self.buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buf)
            if not self._more():
                if self.buf:
                    raise ValueError("the archive ends inside a record's header")
                return None
        out = bytes(self.buf[:at])
        del self.buf[: at + 4]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


READ_SCHEMA = "archive string, record_id string, target_uri string, record_type string, refers_to string, chunk_no int, data binary, running_digest string, last boolean, payload_bytes long, payload_digest string"


def read_archive(path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """Rows of READ_SCHEMA of one archive. Raises ValueError if a payload doesn't match its digest."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    rid = lambda x: unquote(x.strip("<>").removeprefix(ID_SCHEME)) if x else None
    with store.open_input_stream(name, compression=None) as stream:
        src = _Inflated(stream)
        while (head := src.head()) is not None:
            f = _fields(head)
            left = int(f["content-length"])
            kind = f["warc-type"]
            if kind not in ("response", "revisit"):
                while left:
                    left -= len(src.take(min(left, chunk_bytes)))
                src.take(4)
                continue
            http = src.head()
            left -= len(http) + 4
            size, told = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha256:")
            base = (path, rid(f["warc-record-id"]), f.get("warc-target-uri"), kind, rid(f.get("warc-refers-to")))
            if kind == "revisit":
                yield (*base, 0, None, told, True, size, told)
            else:
                h, k = hashlib.sha256(), 0
                while True:
                    data = src.take(min(left, chunk_bytes))
                    left -= len(data)
                    h.update(data)
                    if not left and h.hexdigest() != told:
                        raise ValueError(f"{path}: the payload of {base[1]} does not match its digest")
                    yield (*base, k, data if with_data else None, h.hexdigest(), not left, size, told)
                    k += 1
                    if not left:
                        break
            src.take(4)


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives in ``manifest``, one archive a task."""
    types = (pa.string(),) * 5 + (pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.string())
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def read(batches):
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in read_archive(path, chunk_bytes, with_data):
                    rows.append(row)
                    held += 300 + len(row[6] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back; a row per record."""
    manifest = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"), "page_id", "html", "url")
    rows = read_warc(manifest, with_data=False).where("last")
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""
}
