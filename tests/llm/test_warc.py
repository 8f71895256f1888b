"""Archives: round trips, revisits, foreign archives."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from karvan.llm import warc
from karvan.llm.common import written
from karvan.llm.q_records import op11_warc
from karvan.llm.warc import assemble, field, http_parts, originals, read_archives, records_in, with_digests, with_originals, write_archives

LONG, OTHER = "<p>é" * 400 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "x" * 50, "y" * 1000
PAGES = [
    (1, "http://a.example/x y?q=1", LONG),
    (2, "https://b.example", LONG),
    (3, None, LONG),
    (4, "no scheme", None),
    (5, "http://c.example/\r\nInjected: 1", "short"),
    (6, "http://c.example/", "short"),
    (7, "http://d.example/", OTHER),
    (7, "http://d.example/", OTHER),
    (8, "http://e.example/", "z" * 999),
    (9, "http://e.example/", "z" * 999),
    (None, "http://n.example/", OTHER),
    (None, "http://n.example/1", "n" * 2000),
    (None, "http://n.example/2", "n" * 2000),
    (10, "http://l.example/", "long " * 200_000),
]


def _want(pages):
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "").encode() == body and p is not None]
        again = len(body) >= 1000 and ids and page_id != max(ids)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("type", F.lit("clash")).repartition(3)


def test_query_is_the_definition(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op11_warc(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == _want(PAGES)
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op11_warc(spark, f"{tmp_path}/none").count() == 0


def test_round_trip_of_nested_rows(spark, pages, tmp_path):
    assert write_archives(pages, f"{tmp_path}/w", archive_bytes=4000) == len(PAGES)
    records = written(read_archives(spark, f"{tmp_path}/w"), "t-records")
    assert records.select("archive").distinct().count() > 3
    rows = assemble(records).withColumn("page_id", field(F.col("metadata.payload"), "page-id").cast("long"))
    out = {(r.page_id, r.target_uri): r for r in rows.collect()}
    assert len(out) == len(PAGES) - 1
    assert out[1, "http://a.example/x%20y?q=1"].request.http_head == "GET /x%20y?q=1 HTTP/1.1\r\nHost: a.example"
    assert out[5, "http://c.example/Injected:%201"].payload == b"short"
    assert out[3, None].payload == LONG.encode() and out[3, None].payload_digest == "sha1:" + hashlib.sha1(LONG.encode()).hexdigest()
    assert out[1, "http://a.example/x%20y?q=1"].payload == b"" and all(r.n_request == r.n_metadata == 1 for r in out.values())
    for r in with_originals(rows, ["page_id", "payload"], 64).where("type = 'revisit'").collect():
        assert r.original.payload == (LONG if r.page_id in (1, 2) else OTHER).encode()


def test_a_hot_payload_is_cut_into_parts(spark):
    rows = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h" * 1500).alias("html"))
    parts = originals(with_digests(rows, 64)).collect()
    assert 50 < len(parts) <= 64 and {p.original.page_id for p in parts} == {499}


def _warc(kind, rid, block, *more, ctype="application/http"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: {rid}", *more, f"Content-Type: {ctype}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    parts = [
        _warc("warcinfo", "<i>", b"software: x\r\n", ctype="application/warc-fields"),
        _warc("response", "<a>", body, "WARC-Concurrent-To: <q>", "WARC-Concurrent-To:", " <m>"),
        _warc("request", "<q>", b"GET / HTTP/1.1\r\n\r\n"),
        _warc("metadata", "<m>", b"a: b\r\n", ctype="application/warc-fields"),
        _warc("metadata", "<m2>", b"a: c\r\n", "WARC-Concurrent-To: <a>", ctype="application/warc-fields"),
        _warc("response", "<alone>", b"no body"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join([gzip.compress(p) for p in parts]))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(parts[0] + parts[1])[:-40])
    (tmp_path / "three.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"))
    records = written(read_archives(spark, str(tmp_path)), "t-foreign")
    assert records.where("type = 'damaged'").count() == 2
    whole = assemble(records.where("archive LIKE '%one%'")).collect()
    by_id = {r.record_id: r for r in whole}
    assert set(by_id) == {"<a>", "<alone>"} and by_id["<a>"].payload == b"Wikipedia"
    assert by_id["<a>"].request.record_id == "<q>" and by_id["<a>"].metadata.record_id == "<m2>" and by_id["<a>"].n_metadata == 2
    assert by_id["<alone>"].request is None and by_id["<alone>"].payload == b""
    assert http_parts(b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n")[1] == b""
    assert [r["type"] for r in records_in(b"\r\n\r\n" + parts[0])] == ["warcinfo"] and list(records_in(b"")) == []
    assert warc.BATCH_BYTES >= 1 << 20
