import base64
import gzip
import hashlib
import io

import pytest

from quire.llm import warc
from quire.llm.warc import op3_warc

from .helpers import sf_dir_of

SCHEMA = "page_id long, url string, html string, payload_digest string"


def pages(spark):
    rows = [(7, "http://a/x y\r\nz", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b", None), (10, "u", ""), (11, "u", "é" * 5000), (12, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "no id"), (None, "u", "<p>same</p>"), (11, "u", "é" * 5000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for p, data in payload:
        ids = [q for q, d in payload if d == data and q is not None]
        first = min(ids) if ids else None
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_equals_brute_force(spark, tmp_path):
    df = pages(spark).repartition(2)
    got = op3_warc(spark, sf_dir_of(spark, tmp_path, pages=df)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(df.collect()), key=key)


def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, op3_warc(spark, sf).collect()), key=key) == sorted(brute(rows), key=key)


def test_payloads_come_back_chunk_by_chunk(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    manifest = warc.write(warc.chunked(warc.plan_records(pages(spark).filter("page_id = 11 or page_id = 12").dropDuplicates(["page_id"])), 1000), path, file_bytes=100)
    assert manifest.agg({"records": "sum"}).first()[0] == 2
    rows = warc.read(manifest, path, 700).filter("page_id = 11").orderBy("chunk_no").collect()
    assert len(rows) == 15 and b"".join(r.data for r in rows) == ("é" * 5000).encode()
    so_far = hashlib.sha1()
    for r in rows:
        so_far.update(r.data)
        assert r.prefix_digest == base64.b32encode(so_far.digest()).decode()
    assert [r.is_last for r in rows] == [False] * 14 + [True]


def test_damage_is_seen():
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: %d\r\n\r\n" % len(body)
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(head + body + b"\r\n\r\n")))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(head + body[:-2])))


def test_empty_table(spark, tmp_path):
    assert op3_warc(spark, sf_dir_of(spark, tmp_path, pages=pages(spark).limit(0))).count() == 0


def test_long_header_lines_and_warcinfo(spark, tmp_path):
    url = "http://a/" + "x" * 200_000
    df = spark.createDataFrame([(1, url, "<p>one</p>"), (2, url, "<p>one</p>")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write(warc.chunked(warc.plan_records(df)), path)
    rows = warc.read(manifest, path).collect()
    assert sorted((r.page_id, r.record_type, r.url == url) for r in rows) == [(1, "response", True), (2, "revisit", True)]
    name = manifest.first().file
    assert gzip.decompress((tmp_path / "w" / name).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_a_payload_that_most_pages_share(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", "<p>same</p>" if k % 3 else f"own {k}") for k in range(300)], "page_id long, url string, html string")
    got = op3_warc(spark, sf_dir_of(spark, tmp_path, pages=df)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r.page_id, r.url, r.html) for r in df.collect()]), key=key)
