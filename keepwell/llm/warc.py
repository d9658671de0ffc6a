"""WARC archives: written from pages, read back, and put together capture by capture.

Writing: every page is a capture of three records. The response holds the page (an HTTP head and the
payload); the request and the metadata record name it as WARC-Concurrent-To. Of equal payloads of at
least LEAST bytes only one is written as a response, that of the least id; the others become revisit
records, which carry the digest and the HTTP head and refer to it. Which one stays is an aggregate per
digest, so a payload that a third of the pages share is one row after the map side. Archives are
gzip files of Spark's text sink, records delimited as the format asks.

Reading: a file is unpacked piece by piece, records are taken by their Content-Length. Transactions
are assembled by joins: records that name a response, or that a response names, belong to its capture;
those that only name such a record follow one join later, until no record finds a capture. Each
capture is one nested row.

Defined cases: a null html is an empty payload; a null id ranks last and is written without an id, a
null or malformed url without a target; rows that repeat the id and the payload of the response become
revisits of one of them; texts of any length are written whole (a file below 2 GB can be read); a
capture with several requests or metadata records shows the least record id of each kind and counts
them, loose() has the rest; a record without a capture is a row of its own; warcinfo, conversion and
continuation records are no captures; an empty table gives no archive and an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored, text_of

LEAST = 100  # bytes from which an equal payload is not written twice
DATE = "2024-01-01T00:00:00Z"
ANCHORS = ("response", "revisit", "resource")
RECORDS_PER_FILE = 100_000
SALTS = 32
#: Fixed values.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

RECORD = ("record_id string, kind string, target string, concurrent array<string>, refers string, digest string, "
          "page_id long, http_status int, http_length long, fields string")
_PIECE = 1 << 20


# -- writing ------------------------------------------------------------------------------------

def _record(kind: str, record_id: Column, more: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """A record without its closing line ends; headers whose value is null are left out."""
    lines = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *more,
             ("Content-Type", F.lit(content)), ("Content-Length", F.octet_length(block).cast("string"))]
    shown = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines]
    return F.concat(F.lit("WARC/1.1" + CRLF), *shown, F.lit(CRLF), block, F.lit(CRLF))


def _urn(kind: str, *parts: Column) -> Column:
    """<urn:uuid:...> from a hash of the parts."""
    h = F.md5(F.concat_ws("/", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = text_of(html_col)
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("digest"))


def _leaders(rows: DataFrame) -> DataFrame:
    """Of every payload that is there more than once: digest, of the first id and how many rows have it."""
    each = rows.where(F.col("n_bytes") >= LEAST).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")
    found = each.groupBy("digest").agg(F.min(rank).alias("k"), F.sum("n").alias("all"))
    return found.where(F.col("all") > 1).select(F.col("digest").alias("of"), F.col("k.page_id").alias("first_id"),
                                                F.col("k.n").alias("first_n"))


def _typed(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows with record_type; among rows that repeat the first id of a payload, one is the response."""
    joined = rows.join(leaders, (rows["digest"] == leaders["of"]) & (rows["n_bytes"] >= LEAST), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id"))
    names = ["page_id", "url", "payload", "n_bytes", "digest", "first_id", "of", "record_type"]
    kind = F.when(F.col("of").isNull() | (is_first & (F.col("first_n") == 1)), "response").when(
        ~is_first, "revisit")
    joined = joined.withColumn("record_type", kind)
    if leaders.where("first_n > 1").isEmpty():
        return joined.select(*names)
    # rows of one id and payload: one row per url and its count, then as many rows again
    tied = joined.where("record_type IS NULL").groupBy("page_id", "url", "n_bytes", "digest", "first_id", "of").agg(
        F.first("payload").alias("payload"), F.count("*").alias("n"))
    least = tied.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("k")).select(
        F.col("digest").alias("d"), F.col("k.url").alias("u"))
    tied = tied.join(least, (tied["digest"] == least["d"]) & tied["url"].eqNullSafe(least["u"]), "left")
    tied = tied.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn(
        "record_type", F.when(F.col("d").isNotNull() & (F.col("no") == 1), "response").otherwise("revisit"))
    return joined.where("record_type IS NOT NULL").select(*names).unionByName(tied.select(*names))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives below path, three records per row of pages."""
    rows = _rows(pages, id_col, url_col, html_col)
    spark = pages.sparkSession
    leaders = stored(_leaders(rows.drop("payload")), shared_folder(spark), "leaders")
    typed = _typed(rows, leaders).withColumn("nonce", F.monotonically_increasing_id())
    revisit = F.col("record_type") == "revisit"
    leader = _urn("first", F.col("digest"))  # one response per payload that has copies
    own = F.when(~revisit & F.col("of").isNotNull(), leader).otherwise(
        _urn("capture", F.col("page_id"), F.col("digest"), F.col("nonce")))
    parts = typed.withColumn("own", own)
    clean = F.regexp_replace("url", r"[\x00-\x20]", "")  # a header is one line
    # bytes beyond ASCII have no place in a header
    target = F.when(F.col("url").contains("://"), F.concat_ws("", F.transform(
        F.split(clean, ""), lambda c: F.when(c.rlike("[^\\x21-\\x7e]"), F.url_encode(c)).otherwise(c))))
    parts = parts.withColumn("target", target)
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
                          + "Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    place = F.regexp_extract("target", r"^[^/]*//([^/?#]*)([^#]*)", 1)
    asked = F.regexp_extract("target", r"^[^/]*//([^/?#]*)([^#]*)", 2)
    asked = F.when(asked.startswith("/"), asked).otherwise(F.concat(F.lit("/"), asked))
    get = F.coalesce(F.concat(F.lit("GET "), asked, F.lit(" HTTP/1.1" + CRLF + "Host: "), place), F.lit("GET / HTTP/1.1"))
    uri = ("WARC-Target-URI", F.col("target"))
    payload_digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = "application/http; msgtype="
    response = _record("response", F.col("own"), [uri, payload_digest], http + "response", F.concat(head, F.col("payload")))
    again = _record("revisit", F.col("own"), [uri, payload_digest, ("WARC-Refers-To", leader), ("WARC-Profile", F.lit(PROFILE))],
                    http + "response", head)
    with_capture = ("WARC-Concurrent-To", F.col("own"))
    request = _record("request", _urn("request", F.col("own")), [uri, with_capture], http + "request",
                      F.concat(get, F.lit(CRLF + CRLF)))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
                     F.lit("fetch: stored page" + CRLF))
    metadata = _record("metadata", _urn("metadata", F.col("own")), [uri, with_capture], "application/warc-fields", about)
    records = parts.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", CRLF).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# -- reading ------------------------------------------------------------------------------------

class _Bytes:
    """Bytes of a plain or gzip file (of one or many members), unpacked as they are asked for."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.held = data, 0, bytearray()
        self.zip = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at:self.at + _PIECE]
        self.at += len(piece)
        if self.zip is None:
            self.held += piece
            return True
        self.held += self.zip.decompress(piece)
        if self.zip.eof:  # the next member begins in what is left
            self.at -= len(self.zip.unused_data)
            self.zip = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                if not self.held:
                    return None
                end = len(self.held)
                break
        out = bytes(self.held[:end]).rstrip(b"\r")
        del self.held[:end + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records_of(data: memoryview | bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; what follows a record without a whole block is given up."""
    file = _Bytes(memoryview(data))
    while (line := file.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue  # line ends between records
        headers = []
        while line := file.line():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and headers:  # a header goes on
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}".strip())
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip().lower(), value.strip()))
        size = next((v for k, v in headers if k == "content-length"), "0")
        block = file.take(int(size) if size.isdigit() else 0)
        yield headers, block


def _http(block: bytes) -> tuple[int | None, int | None, bytes]:
    """(status, announced length, payload) of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    status = re.match(rb"HTTP/\S+ (\d{3})", first)
    length = next((x.partition(b":")[2].strip() for x in lines if x.lower().startswith(b"content-length:")), b"")
    return int(status[1]) if status else None, int(length) if length.isdigit() else None, payload


def _parsed(headers: list[tuple[str, str]], block: bytes) -> tuple[dict, bytes | None]:
    get, kind = dict(reversed(headers)), dict(headers).get("warc-type", "")
    out = {"record_id": get.get("warc-record-id"), "kind": kind, "target": get.get("warc-target-uri"),
           "concurrent": [v for k, v in headers if k == "warc-concurrent-to"], "refers": get.get("warc-refers-to"),
           "digest": get.get("warc-payload-digest", "").removeprefix("sha256:") or None}
    payload = None
    if kind in ("response", "revisit") and get.get("content-type", "").startswith("application/http"):
        out["http_status"], out["http_length"], payload = _http(block)
    elif kind in ("response", "resource"):
        payload = block
    if kind in ("response", "resource"):
        out |= {"digest": sha256(payload).hexdigest(), "http_length": len(payload)}  # of what is there
    else:
        payload = None
    if kind in ("metadata", "request"):
        out["fields"] = block.decode("utf-8", "replace").strip()
    if kind == "metadata" and (known := re.search(r"^page-id: (-?\d+)\s*$", out["fields"], re.M)):
        out["page_id"] = int(known[1])
    return out, payload


def _parse(with_payload: bool):
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(),
             pa.int32(), pa.int64(), pa.string()]

    def made(rows: list[dict], payloads: list) -> pa.RecordBatch:
        columns = [pa.array([r.get(c) for r in rows], t) for c, t in zip(names, kinds)]
        more = [pa.array(payloads, pa.binary())] if with_payload else []
        return pa.RecordBatch.from_arrays(columns + more, names=names + ["payload"] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, payloads, held = [], [], 0
                for headers, block in records_of(memoryview(content.as_buffer())):
                    row, payload = _parsed(headers, block)
                    rows.append(row)
                    payloads.append(payload)
                    held += len(payload or b"") if with_payload else 0
                    if held > 16 << 20 or len(rows) == 5000:
                        yield made(rows, payloads)
                        rows, payloads, held = [], [], 0
                if rows:
                    yield made(rows, payloads)

    return run


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below path; digest and length of a payload are those of its bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), RECORD + ", payload binary" * with_payload)


# -- transactions -------------------------------------------------------------------------------

def _captures(found: DataFrame, folder: str) -> DataFrame:
    """record_id, capture (the record id of its response, revisit or resource) of every record that has one."""
    slim = found.select("record_id", "kind", "concurrent")
    anchors = slim.where(F.col("kind").isin(*ANCHORS)).select("record_id", F.col("record_id").alias("capture")).distinct()
    edges = slim.select("record_id", F.explode("concurrent").alias("other"))
    edges = edges.unionByName(edges.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    fresh = stored(anchors, folder, "captures-0")
    edges = stored(edges.join(fresh, "record_id", "left_anti").distinct(), folder, "edges-0")
    parts = [fresh]
    for turn in itertools.count(1):  # one join per step away from an anchor; archives in use need one
        near = edges.join(fresh.select(F.col("record_id").alias("other"), "capture"), "other").groupBy("record_id").agg(
            F.min("capture").alias("capture"))
        fresh = stored(near, folder, f"captures-{turn}")
        edges = stored(edges.join(fresh, "record_id", "left_anti"), folder, f"edges-{turn}")
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if edges.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, parts)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture, page_id, response, request, metadata and how many there are of
    each; found: records()."""
    folder = shared_folder(found.sparkSession)
    found = stored(found, folder, "records")
    anchored = _captures(found, folder).withColumnRenamed("record_id", "member")
    names = [c for c in found.columns if c != "kind"]
    rows = found.where(F.col("kind").isin(*ANCHORS, "request", "metadata")).join(
        anchored, F.col("record_id") == F.col("member"), "left")
    rows = rows.withColumn("capture", F.coalesce("capture", "record_id"))
    row = F.struct("record_id", "kind", *names[1:])

    def least(*kinds: str) -> Column:
        return F.min_by(F.when(F.col("kind").isin(*kinds), row), F.when(F.col("kind").isin(*kinds), F.col("record_id")))

    def many(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    return rows.groupBy("capture").agg(
        F.min("page_id").alias("page_id"), least(*ANCHORS).alias("response"),
        least("request").alias("request"), least("metadata").alias("metadata"),
        many("request").alias("requests"), many("metadata").alias("metadata_records"))


def loose(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Records that no row of captures (assemble()) shows."""
    shown = captures.select(F.explode(F.array("response.record_id", "request.record_id", "metadata.record_id")).alias(
        "shown")).where("shown IS NOT NULL")
    return found.join(shown, F.col("record_id") == F.col("shown"), "left_anti")


def digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page of the response) of each capture."""
    flat = captures.where("response IS NOT NULL").select(
        "capture", "page_id", F.col("response.http_length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.col("response.refers").alias("refers"))
    # a response that very many revisits refer to is looked up under SALTS keys; only those that are referred to
    named = flat.where("refers IS NOT NULL").select(F.col("refers").alias("capture")).distinct()
    pages = flat.where("record_type <> 'revisit'").select("capture", F.col("page_id").alias("refers_to")).join(
        named, "capture", "left_semi").select(F.col("capture").alias("of"), "refers_to", F.explode(
            F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    flat = flat.withColumns({"key": F.coalesce("refers", "capture"),  # no key is null
                             "at": F.pmod(F.xxhash64("capture"), F.lit(SALTS)).cast("int")})
    return flat.join(pages, (F.col("key") == F.col("of")) & (F.col("at") == F.col("salt")), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers").isNotNull(), F.col("refers_to")).alias("refers_to"))
