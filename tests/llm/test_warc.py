import hashlib

import pytest
from pyspark.sql import functions as F

from coexnet.llm import warc
from coexnet.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, data string"


def round_trip(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write_warc(df, new_path(spark, "t"), "page_id", "html", "url", **how)
    return manifest, warc.read_warc(manifest, how.get("chunk_bytes", warc.CHUNK_BYTES)).collect()


def payloads(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        out.setdefault((r["record_id"], r["record_type"], r["refers_to"]), b"")
        out[r["record_id"], r["record_type"], r["refers_to"]] += bytes(r["data"] or b"")
    return out


def test_round_trip_in_chunks(spark):
    long = "x\r\n\r\nWARC/1.1 é" * 4000
    rows = [(1, "http://a/ä b", long, "d", "e"), (2, None, long, None, None), (3, "u\n", "short", "", ""), (4, "u", "short", "", ""), (5, "u", "", "", ""), (6, "u", None, "", ""), (0, "u", "y" * 100, "", ""), (7, "u", "y" * 100, "", "")]
    manifest, got = round_trip(spark, rows, chunk_bytes=1000)
    assert payloads(got) == {
        ("0", "response", None): b"y" * 100, ("1", "response", None): long.encode(), ("2", "revisit", "1"): b"", ("3", "response", None): b"short", ("4", "response", None): b"short",
        ("5", "response", None): b"", ("6", "response", None): b"", ("7", "revisit", "0"): b"",
    }
    assert max(len(r["data"] or b"") for r in got) <= 1000
    last = {r["record_id"]: r for r in got if r["last"]}
    assert last["2"]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest() == last["1"]["running_digest"]
    assert last["2"]["payload_bytes"] == last["1"]["payload_bytes"] == len(long.encode())
    first = next(r for r in got if r["record_id"] == "1" and r["chunk_no"] == 0)
    assert first["running_digest"] == hashlib.sha256(long.encode()[:1000]).hexdigest()
    assert manifest.agg(F.sum("records")).first()[0] == 8


def test_chunks_and_running_digests(spark):
    texts = [None, "", "é" * 700, "x" * 1000, "y" * 1001, "z" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1)
    rows = warc.chunk_table(df, "page_id", "html", chunk_bytes=1000).collect()
    for i, t in enumerate(texts):
        data, mine = (t or "").encode(), [r for r in rows if r["rid"] == i]
        assert [bytes(r["data"]) for r in mine] == [data[a : a + 1000] for a in range(0, max(1, len(data)), 1000)]
        assert all(bytes(r["running_digest"]) == hashlib.sha256(data[: 1000 * (r["chunk_no"] + 1)]).digest() and bytes(r["digest"]) == hashlib.sha256(data).digest() and r["payload_bytes"] == len(data) for r in mine)


def test_ties_null_ids_and_rotation(spark):
    text = "z" * 300
    rows = [(None, "u", text, "", ""), (9, "u", text, "", ""), (9, "u", text, "", ""), (11, "u", text, "", ""), (None, "u", "w" * 200, "", "")]
    manifest, got = round_trip(spark, rows, archive_bytes=1)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in got if r["last"])
    assert kinds == [("", "response", ""), ("", "revisit", "9"), ("11", "revisit", "9"), ("9", "response", ""), ("9", "response", "")]
    assert manifest.count() >= 5


def test_empty_table(spark):
    manifest, got = round_trip(spark, [])
    assert manifest.count() == 0 and got == []


def test_damaged_archive_is_refused(spark, tmp_path):
    import gzip

    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(good))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(f"file://{path}"))
    path.write_bytes(gzip.compress(good[:60]))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(f"file://{path}"))


def test_query(spark, sf):
    rows = warc.op1_warc(spark, sf).collect()
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["payload_digest"] == hashlib.sha256(pages[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(pages[r["page_id"]])
        if r["record_type"] == "revisit":
            assert pages[r["refers_to"]] == pages[r["page_id"]] and r["refers_to"] < r["page_id"]
