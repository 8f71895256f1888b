"""WARC archives: captures written as transactions of records, and put together again.

Writing: every capture becomes a response (or revisit), a request and a metadata record that
name the response in ``WARC-Concurrent-To``. Records are text, so Spark's text sink writes the
archives: a record ends with two line ends, which is the sink's separator. Reading: archives are
parsed record by record at their ``Content-Length``, in a stream of bounded memory, and requests,
responses and metadata are joined through their concurrent-to identifiers, whichever side names
the other, into one nested row per capture. Revisits find what they refer to in a second join.

Equal payloads, or revisits of one response, may be a third of all rows: such keys are joined
in salted parts, of which each holds the key once.

Equal rows are captures of their own, numbered inside one task.

Cases: a null payload is empty; null page ids and urls are left out of the record and come back
null; among equal payloads the largest page id is the response, rows that repeat it are responses
too, and without any page id all are responses; control characters are cut out of urls and
spaces become %20, because a header is one line. Empty tables give empty archives. A damaged
record ends its archive and is a row of type ``damaged``; other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 1000
#: Bytes of records in an archive, before compression, on average.
ARCHIVE_BYTES = 16 << 20
#: Parts of a hot key: one per so many rows, 64 at least.
SALT_ROWS, MIN_SALTS = 1_000_000, 64
#: Records and payload bytes that the reader sends on at once.
BATCH_RECORDS, BATCH_BYTES = 1000, 4 << 20
CRLF = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _urn(capture: Column, kind: str) -> Column:
    """Identifier of a record of a capture: a UUID from a digest of both."""
    h = F.md5(F.concat(capture, F.lit(f"/{kind}")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit(VERSION + CRLF), *headers, length, block)


def with_digests(pages: DataFrame, salts: int) -> DataFrame:
    """``page_id, url, html`` with payload digests and size, and the part of its payload's rows."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(html.cast("binary")).alias("sha1"),
        F.sha2(html.cast("binary"), 256).alias("key"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"),
    )


def _capture(page_id: Column, url: Column, key: Column, copy: Column) -> Column:
    """Identifier of a capture: what it holds, and its number among equal rows."""
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), copy.cast("string"), key, F.coalesce(url, F.lit(""))).cast("binary"))


def originals(captures: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(key, salt, original)`` of the payloads that several captures share.

    Maxima are taken per part of a key and then over its parts, as many rows as there are salts.
    """
    parts = (
        captures.where(F.col("payload_bytes") >= least)
        .groupBy("key", "salt")
        .agg(F.max(F.struct("page_id", "url")).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    whole = Window.partitionBy("key")
    return (
        parts.withColumn("original", F.max("best").over(whole))
        .withColumn("n", F.sum("n").over(whole))
        .where("n > 1 AND original.page_id IS NOT NULL")
        .select(F.col("key").alias("_key"), F.col("salt").alias("_salt"), "original")
    )


def records_of(captures: DataFrame, least: int = MIN_REVISIT_BYTES, captured_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The three records of every capture, as text in a column ``record``.

    Payloads are moved once: rows are dealt by payload and part, which numbers equal rows and
    meets the originals.
    """
    equal = Window.partitionBy("key", "salt", "page_id", "url").orderBy("payload_bytes")
    dealt = captures.repartition("key", "salt").withColumn("_copy", F.row_number().over(equal))
    dealt = dealt.withColumn("capture", _capture(F.col("page_id"), F.col("url"), F.col("key"), F.col("_copy")))
    found = dealt.join(originals(captures, least), (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    original = _capture(F.col("original.page_id"), F.col("original.url"), F.col("key"), F.lit(1))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id")) & (F.col("payload_bytes") >= least)
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), " ", "%20")
    other = F.regexp_replace(F.regexp_replace("original.url", r"[\x00-\x1F\x7F]", ""), " ", "%20")
    response = _urn(F.col("capture"), "response")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    common = [_line("WARC-Target-URI", uri), _line("WARC-Date", F.lit(captured_at))]
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"))
    reply = _line("Content-Type", F.lit("application/http; msgtype=response"))
    full = _record([_line("WARC-Type", F.lit("response")), _line("WARC-Record-ID", response), *common, digest, reply], F.concat(http, "html"))
    again = _record(
        [
            _line("WARC-Type", F.lit("revisit")),
            _line("WARC-Record-ID", response),
            *common,
            digest,
            _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            _line("WARC-Refers-To", _urn(original, "response")),
            _line("WARC-Refers-To-Target-URI", other),
            reply,
        ],
        http,
    )
    rest = F.regexp_extract(uri, r"^[^:]*://([^/?#]*)(.*)$", 2)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    host = F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1)
    request = _record(
        [_line("WARC-Type", F.lit("request")), _line("WARC-Record-ID", _urn(F.col("capture"), "request")), _line("WARC-Concurrent-To", response), *common, _line("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF + CRLF)),
    )
    metadata = _record(
        [_line("WARC-Type", F.lit("metadata")), _line("WARC-Record-ID", _urn(F.col("capture"), "metadata")), _line("WARC-Concurrent-To", response), *common, _line("Content-Type", F.lit("application/warc-fields"))],
        _line("page-id", F.col("page_id")),
    )
    return found.select(F.explode(F.array(request, F.when(revisit, again).otherwise(full), metadata)).alias("record"))


def salts_for(rows: int) -> int:
    return max(MIN_SALTS, rows // SALT_ROWS)


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write ``page_id, url, html`` rows as gzipped archives of about ``archive_bytes`` each.

    ``pages`` is read three times. Returns the number of captures.
    """
    rows, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0))).first()
    records = max(3, 3 * int(archive_bytes / (size / max(rows, 1) + 1500)))
    text = records_of(with_digests(pages, salts_for(rows)), least)
    text.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    return rows


RECORD = (
    "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, warc_date string, "
    "content_type string, payload_digest string, http_head string, payload binary, payload_bytes long, payload_sha1 string, archive string"
)


def _headers(stream: io.BufferedIOBase) -> dict[bytes, list[bytes]] | None:
    """Header lines up to the empty one, names in lower case; folded lines are joined."""
    found: dict[bytes, list[bytes]] = {}
    last = None
    while line := stream.readline():
        if not line.strip():
            return found
        if line[:1] in b" \t" and last is not None:
            last[-1] = (last[-1] + b" " + line.strip()).strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = found.setdefault(name.strip().lower(), [])
        last.append(value.strip())
    return None


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP message; chunks are put together."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return head, body
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return head, b"".join(parts)


def records_in(content: bytes) -> Iterator[dict]:
    """Records of an archive, plain or gzipped (as a whole or record by record)."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            headers = _headers(stream) if line.startswith(b"WARC/") else None
            length = int(headers[b"content-length"][0]) if headers is not None else -1
            block = stream.read(length) if length >= 0 else b""
            if len(block) != length:
                raise ValueError("short or malformed record")
            one = {k.decode("utf-8", "replace"): v[0].decode("utf-8", "replace") for k, v in headers.items()}
            kind = one.get("content-type", "")
            head, payload = http_parts(block) if kind.startswith("application/http") else (None, block)
            yield {
                "type": one.get("warc-type"),
                "record_id": one.get("warc-record-id"),
                "concurrent_to": [v.decode("utf-8", "replace") for v in headers.get(b"warc-concurrent-to", [])],
                "refers_to": one.get("warc-refers-to"),
                "target_uri": one.get("warc-target-uri"),
                "warc_date": one.get("warc-date"),
                "content_type": kind,
                "payload_digest": one.get("warc-payload-digest"),
                "http_head": None if head is None else head.decode("utf-8", "replace"),
                "payload": payload,
                "payload_bytes": len(payload),
                "payload_sha1": sha1(payload).hexdigest(),
            }
    except (ValueError, KeyError, EOFError, OSError, zlib.error):
        yield {"type": "damaged"}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, one row each; whole archives fit in memory."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for record in records_in(content.as_py()):
                    rows.append(record | {"archive": where})
                    size += record.get("payload_bytes", 0)
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "long": pa.int64()}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in RECORD.split(", ")])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its ``request`` and ``metadata``.

    ``records`` is read several times, so give a written table. Of several requests (or metadata
    records) that name one response, the one with the smallest identifier is kept and ``n_*``
    tells how many there were; without any it is null.
    """
    captures = records.where(F.col("type").isin(*CAPTURES))
    named = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("member"))
    out = captures.drop("concurrent_to", "archive")
    for kind in ("request", "metadata"):
        rows = records.where(F.col("type") == kind)
        direct = rows.select(F.explode("concurrent_to").alias("capture_id"), F.col("record_id").alias("member"))
        links = direct.unionByName(named).distinct()
        body = rows.select(F.col("record_id").alias("member"), F.struct("record_id", "target_uri", "content_type", "http_head", "payload").alias(kind))
        linked = links.join(body, "member").groupBy("capture_id").agg(F.min(kind).alias(kind), F.count(F.lit(1)).alias(f"n_{kind}"))
        out = out.join(linked, out["record_id"] == linked["capture_id"], "left").drop("capture_id")
    return out


def with_originals(captures: DataFrame, carried: list[str], salts: int) -> DataFrame:
    """Add a struct ``original`` with columns of the response that a revisit refers to."""
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    wanted = captures.where(F.col("type") == "revisit").select(F.col("refers_to").alias("_to"), salt.alias("_salt")).distinct()
    targets = captures.where(F.col("type") == "response").select(F.col("record_id").alias("_id"), F.struct(*carried).alias("original"))
    found = wanted.join(targets, F.col("_to") == F.col("_id")).drop("_id")
    return captures.join(found, (F.col("refers_to") == F.col("_to")) & (salt == F.col("_salt")), "left").drop("_to", "_salt")


def field(block: Column, name: str) -> Column:
    """Value of a field of an ``application/warc-fields`` block; null without it."""
    value = F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)
