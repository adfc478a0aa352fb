import base64
import hashlib

from pyspark.sql import functions as F

from parcelforge.llm import warc
from parcelforge.llm.tables import fresh_path

SCHEMA = "page_id long, url string, html string, file string, digest string"


def brute(rows, least):
    by = {}
    for i, _, h in ((i, u, h) for i, u, h in rows if i is not None):
        if len((h or "").encode()) >= least:
            by.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(by.get(h or "", [i]))
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "response" if top == i else "revisit", None if top == i else top))
    return sorted(out)


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"<p>{'é' * i} page {i}</p>\r\n\r\n" * (i % 5 + 1)) for i in range(120)]
    rows += [(200, "u", None), (201, None, ""), (202, "u\r\nX: y", "same"), (203, "u", "same"), (204, "u", fake), (205, "u", "a" + fake * 3 + "WARC/1.1\r\n"), (206, "u", "WARC/1.1\r\n"), (207, "u", "x" * 300_000 + fake), (208, "u", fake)]
    return rows


def test_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA).repartition(3)
    got = warc.archived_pages(frame).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, 0)


def test_small_byte_ranges_and_small_files(spark, monkeypatch):
    rows = pages()
    monkeypatch.setattr(warc, "FILE_RECORDS", 25)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = warc.archived_pages(spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, 0)


def test_least_bytes_for_revisits(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "long enough"), (4, "u", "long enough"), (5, "u", None), (6, "u", "")]
    path = fresh_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA), path, revisit_from=8)
    kinds = {r.record_id: r.kind for r in warc.read_warc(spark, path).collect()}
    assert {k: v for k, v in kinds.items() if v == "revisit"} == {"<urn:page:3>": "revisit"}


def test_null_ids_are_responses_of_their_own(spark):
    frame = spark.createDataFrame([(None, "u", "x", "f", "d"), (None, None, None, "f", "d"), (1, "u", "x", "f", "d")], SCHEMA)
    got = warc.archived_pages(frame).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got) == [(0, 0, "response"), (0, 1, "response"), (1, 1, "response")]


def test_file_is_a_warc(spark):
    path = fresh_path(spark, "warc-file")
    warc.write_warc(spark.createDataFrame([(1, "http://x", "héllo", "f", "d")], SCHEMA), path)
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).first().content
    head, _, body = bytes(raw).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and b"Content-Length: 6" in head and body == "héllo".encode() + b"\r\n\r\n"


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "x"), (1, "u", "x")]
    got = warc.archived_pages(spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response")] * 2
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id_keep_their_payloads(spark):
    rows = [(1, "u", "A"), (1, "u", "B"), (2, "u", "A"), (2, "u", "C"), (3, "u", "C"), (3, "u", "B"), (3, "u", None), (1, "u", "")]
    got = warc.archived_pages(spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA).repartition(3)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute(rows, 0), key=str)


def test_one_payload_on_most_pages(spark, monkeypatch):
    from parcelforge.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 50)
    rows = [(i, "u", "popular") for i in range(300)] + [(300 + i, "u", f"own {i // 2}") for i in range(100)]
    got = warc.archived_pages(spark.createDataFrame([(*r, "f", "d") for r in rows], SCHEMA).repartition(4)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, 0)


def test_other_archives_are_read(spark, tmp_path):
    """Records of version 1.0 and 1.1, warcinfo among them, one of them in gzip members."""
    import gzip

    def record(version, kind, name, block):
        head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:{name}>\r\nWARC-Target-URI: http://x/{name}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    records = [record("1.0", "warcinfo", "a", b"software: x\r\n"), record("1.1", "response", "b", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n"), record("1.0", "response", "c", b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    want = [("<urn:a>", "warcinfo", b"software: x\r\n"), ("<urn:b>", "response", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n"), ("<urn:c>", "response", b"")]
    want = [(i, k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, k, b in want]
    assert sorted((r.record_id, r.kind, r.content, r.digest) for r in got) == sorted(want * 2)
