import gzip
import random
from hashlib import sha256

from pyspark.sql import functions as F

from keepwell.llm import warc

KIND = "page_id long, url string, html string, digest string, of string"


def slow(rows):
    first = {}
    for i, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    out, seen = [], set()
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        leads = len(raw) < 100 or (i == first[html or ""] and html not in seen)
        if leads and len(raw) >= 100:
            seen.add(html)
        out.append((i, len(raw), sha256(raw).hexdigest(), "response" if leads else "revisit",
                    None if leads else first[html or ""]))
    return sorted(out, key=str)


def pages():
    rng = random.Random(3)
    rows = [(i, f"https://host{i % 5}.example/p/{i}?q=ä b#f", f"<p>{rng.random()}</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response"
             * rng.randrange(1, 9)) for i in range(80)]
    rows += [(200 + i, f"http://copy.example/{i}", rows[5][2] + "x" * 200) for i in range(90)]  # one large group
    rows += [(300 + i, None, "short") for i in range(4)]
    rows += [(400, "no url", None), (401, "", ""), (None, "http://a.example", "y" * 500), (None, "http://b.example", "y" * 500),
             (402, "http://c.example", "ü " * 400_000), (403, "http://d.example\r\nEvil: 1", "z" * 50)]
    rows += [(500, "http://e.example/", "t" * 150)] * 3 + [(500, "http://e.example/other", "t" * 150), (501, None, "t" * 150)]
    return [(*r, "d", "o") for r in rows]


def test_round_trip_and_record_types(spark, tmp_path):
    rows = pages()
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    warc.write(docs, f"{tmp_path}/a")
    found = warc.records(spark, f"{tmp_path}/a")
    captures = warc.assemble(found).cache()
    assert captures.count() == len(rows)
    assert sorted(map(tuple, warc.digests(captures).collect()), key=str) == slow(rows)
    for r in captures.collect():
        assert r.request.concurrent == [r.capture] == r.metadata.concurrent
        assert r.requests == r.metadata_records == 1 and r.response.http_status == 200
        assert "\n" not in (r.response.target or "") and r.request.fields.startswith("GET /")
    bytes_of = {r.page_id: bytes(r.response.payload) for r in captures.collect() if r.response.kind == "response"}
    assert all(bytes_of[i] == (html or "").encode() for i, _, html, *_ in rows if i in bytes_of and i is not None)
    assert warc.loose(found, captures).count() == 0
    slim = warc.digests(warc.assemble(warc.records(spark, f"{tmp_path}/a", with_payload=False)))
    assert sorted(map(tuple, slim.collect()), key=str) == slow(rows)


def record(kind, name, block, *more):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nX: 1\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"
    typed = "Content-Type: application/http; msgtype=response"
    parts = [record("warcinfo", "<i>", b"software: x"),
             record("response", "<r1>", http, typed, "WARC-Concurrent-To: <q1>"),  # the response names the request
             record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n"),
             record("metadata", "<m1>", b"page-id: 12\r\n", "WARC-Concurrent-To: <q1>"),  # known by way of the request
             record("metadata", "<m0>", b"more: 1\r\n", "WARC-Concurrent-To:\r\n <r1>"),
             record("resource", "<r2>", b"plain"),
             record("request", "<q9>", b"GET /lost HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <gone>")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # a member per record
    (tmp_path / "y.warc").write_bytes(record("metadata", "<m2>", b"a: b", "WARC-Concurrent-To: <r2>") + b"WARC/1.1\r\ncut")
    found = warc.records(spark, str(tmp_path)).where("record_id IS NOT NULL")
    got = {r.capture: r for r in warc.assemble(found).collect()}
    assert set(got) == {"<r1>", "<r2>", "<q9>"}
    one = got["<r1>"]
    assert (one.request.record_id, one.metadata.record_id, one.metadata_records) == ("<q1>", "<m0>", 2)
    assert one.response.http_status == 404 and bytes(one.response.payload) == b"body\r\n\r\nWARC/1.1\r\n"
    assert one.page_id == 12 and got["<q9>"].response is None
    assert bytes(got["<r2>"].response.payload) == b"plain" and got["<r2>"].metadata.record_id == "<m2>"
    rest = warc.loose(found, warc.assemble(found)).where(F.col("kind") != "warcinfo")
    assert [r.record_id for r in rest.collect()] == ["<m1>"]


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], KIND), f"{tmp_path}/a")
    captures = warc.assemble(warc.records(spark, f"{tmp_path}/a"))
    assert captures.count() == 0 and warc.digests(captures).count() == 0
