import gzip
import hashlib

from pyspark.sql import functions as F

from shelfline.llm import warc as W
from tests.llm.helpers import save

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"


def test_op3_on_odd_pages(spark, tmp_path):
    rows = [
        (5, "http://a/x?q=1", BIG), (3, "http://b/", BIG), (9, None, BIG), (None, "no scheme", BIG), (4, "http://c/\r\nInjected: 1", "small"),
        (6, "http://c/", "small"), (7, "http://d/", None), (8, "", ""), (10, "http://ü/é", "ü" * 60), (11, "http://e", "ü" * 60), (4, "http://other", BIG + "!"),
    ]
    sf = save(spark, tmp_path, pages=spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as size", "'x' as DIGEST"))
    got = sorted((tuple(r) for r in W.op3_warc(spark, sf).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same) if len(raw) >= 100 and same else page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert got == sorted(want, key=str)


def test_repeated_and_empty(spark, tmp_path):
    sf = save(spark, tmp_path / "a", pages=spark.createDataFrame([(1, "http://a", BIG)] * 3, PAGES))
    assert [(r.page_id, r.record_type) for r in W.op3_warc(spark, sf).collect()] == [(1, "response")] * 3
    sf = save(spark, tmp_path / "b", pages=spark.createDataFrame([], PAGES))
    assert W.op3_warc(spark, sf).count() == 0


def record(kind, rid, block, *headers):
    return "\r\n".join([f"WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *headers, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_members_orphans_and_malformed_tails(spark, tmp_path):
    http = "Content-Type: application/http; msgtype=response"
    records = [
        record("response", "<r1>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\x00\xff", http),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>", "Content-Type: application/http; msgtype=request"),
        record("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>"),
        record("metadata", "<m9>", b"a: 1\r\nb: 2\r\n", "WARC-Concurrent-To: <gone>", "Content-Type: application/warc-fields"),
        b"rubbish",
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    read = W.read_archives(spark, f"{tmp_path}/w").cache()
    rows = {r.record_id: r for r in read.collect()}
    assert bytes(rows["<r1>"].payload) == b"body\x00\xff" and rows["<m9>"].fields == {"a": "1", "b": "2"}
    assert rows[None].type == "malformed" and bytes(rows[None].payload) == b"rubbish"
    (capture,) = W.assembled(read).collect()
    assert capture.request.record_id == "<q1>" and capture.metadata is None and capture.response.size == 6
    assert [r.record_id for r in W.unlinked(read).collect()] == ["<m9>"]


def test_written_records_are_concurrent(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(1, "http://h/p", BIG)], PAGES), f"{tmp_path}/w")
    kinds = {r.type: r for r in W.read_archives(spark, f"{tmp_path}/w").withColumn("n", F.length("payload")).collect()}
    assert set(kinds) == {"request", "response", "metadata"}
    assert kinds["request"].concurrent_to == kinds["metadata"].concurrent_to == kinds["response"].record_id


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 3_000_000)
    rows = [(i, f"http://h/{i}", f"{i} " + "y" * 1_000_000) for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    W.write_archives(pages, f"{tmp_path}/w")
    files = [p for p in (tmp_path / "w").rglob("*.gz")]
    assert len(files) == 4 and all(len(gzip.decompress(p.read_bytes())) < 4_100_000 for p in files)
    assert W.read_archives(spark, f"{tmp_path}/w").filter("type = 'response'").agg(F.sum(F.length("payload"))).first()[0] == sum(len(h) for *_, h in rows)


def test_stated_digests_are_compared(spark, tmp_path):
    http, good = "Content-Type: application/http; msgtype=response", hashlib.sha256(b"body").hexdigest()
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    digests = {"<a>": f"sha256:{good}", "<b>": "sha256:" + "0" * 64, "<c>": "sha1:ABC", "<d>": f"SHA256:{good.upper()}"}
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.gz").write_bytes(gzip.compress(b"".join(record("response", k, block, http, f"WARC-Payload-Digest: {d}") for k, d in digests.items())))
    got = {r.capture_id: r.response.intact for r in W.assembled(W.read_archives(spark, f"{tmp_path}/w")).collect()}
    assert got == {"<a>": True, "<b>": False, "<c>": None, "<d>": True}
