from __future__ import annotations

import glob
import gzip
import hashlib
import io
import zlib

from barsmith.llm import warc as R
from barsmith.llm.common import fresh_path, read

BIG = "x" * 1500
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/7", "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 90), (8, "http://a/8\r\nX: y", "é" * 600), (8, "http://a/8", "é" * 600), (None, "http://a/9", BIG), (9, "http://a/10", "")]


def expected(rows):
    top = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            top[h] = max(i, top.get(h, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = top.get(h) if len(raw) >= 1000 else None
        again = first is not None and i != first
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in PAGES], "page_id long, url string, html string, payload_bytes long, payload_digest string")
    path = fresh_path(spark, "warc-test")
    R.deduplicate(pages, path)
    assert sorted(map(tuple, R.resolved_headers(R.read_archives(spark, path)).collect()), key=str) == expected(PAGES)


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in read(spark, sf, "pages").collect()]
    assert sorted(map(tuple, R.op7_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)


def test_archives_are_members_that_any_gzip_reader_takes(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = fresh_path(spark, "warc-members")
    R.deduplicate(pages, path)
    found = 0
    for name in glob.glob(path.removeprefix("file://") + "/part-*"):
        data = open(name, "rb").read()
        records = [zlib.decompress(m, 31) for m in data.split(R.EMPTY.encode("latin-1")) if m]
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        assert gzip.decompress(data) == b"".join(records) if data else not records
        assert sum(1 for _ in R.parse(io.BytesIO(b"".join(records)), chunk=7)) == len(records)
        found += len(records)
    assert found == len(PAGES)
    assert list(R.parse(io.BytesIO(b""))) == []


def test_many_originals_meet_their_records_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_SENT", 0)
    path = fresh_path(spark, "warc-salted")
    R.deduplicate(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    assert sorted(map(tuple, R.resolved_headers(R.read_archives(spark, path)).collect()), key=str) == expected(PAGES)


def test_empty(spark):
    path = fresh_path(spark, "warc-none")
    R.deduplicate(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert R.resolved_headers(R.read_archives(spark, path)).count() == 0
