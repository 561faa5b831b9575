"""WARC archives: write captures, read them back, assemble transactions.

Writing: each page gives three records, a request, a response (or a revisit)
and a metadata record; request and metadata name the response in
WARC-Concurrent-To.  Of pages with equal payloads of at least ``min_revisit``
bytes, that with the largest id is the response and the others are revisits
that name it in WARC-Refers-To.  Archives are written by Spark's text writer
with the record separator as line separator, so they go to any file system
Spark knows, under its commit protocol.

Reading: ``binaryFile`` rows (their size is bounded by ``archive_bytes``) are
unpacked in chunks and parsed by Content-Length; the records come back as rows.  Transactions:
the responses join their requests and metadata records through the
concurrent-to identifiers and give one nested row per capture.

Defined cases: a null payload is empty, a null url gives no target header;
line breaks and blanks in a url are percent-encoded; repeated rows give equal
records and one capture each; pages of one payload that tie for the largest
id are all responses; a null id is smaller than any other; pages of one id and
payload share their record ids.  A capture without request or metadata record
holds null there; of several the smallest record is nested and the number
given.  An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgscope.llm import common
from pkgscope.session import cut_lineage, ensure_checkpoint_dir

CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _id(kind: str, page="id", digest="digest"):
    """Record id as a URI that carries the page id: legal, and no lookup is needed to get back to the page."""
    return F.concat(F.lit("<urn:x-capture:"), F.coalesce(F.url_encode(F.col(page).cast("string")), F.lit("")), F.lit(":"),
                    F.col(digest), F.lit(f":{kind}>"))


def _record(kind, record_id, headers: list, block, length):
    """One record's text: headers (null ones are left out), blank line, block."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"),
             *headers, F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END), block)


def revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """``id, digest, original``: the pages (id, digest, bytes) whose payload a larger id also has."""
    big = pages.filter(F.col("bytes") >= min_revisit)
    firsts = big.groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1 AND original IS NOT NULL")
    firsts = cut_lineage(firsts.select("digest", "original"))
    return big.join(firsts, "digest").filter("NOT (id <=> original)").select("id", "digest", "original").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit: int = 1000, records_per_file: int = 4000, archive_bytes: int = 1 << 27) -> None:
    """Write gzip-compressed WARC files below ``path``.  Only ids and digests
    are shuffled to find revisits; payloads move once, by page id.  No archive
    holds more than ``archive_bytes`` of payloads (but for a single larger
    one): pages too large for ``records_per_file`` go to files of fewer."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    page = pages.select(F.col(f"`{id_col}`").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"),
                        F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    slim = cut_lineage(page.select("id", "digest", "bytes"))
    again = revisits(slim, min_revisit).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "original")
    page = page.alias("p").join(again.alias("r"), F.expr("p.id <=> r.rid AND p.digest = r.rdigest"), "left")

    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    is_revisit = F.col("rdigest").isNotNull()  # rid is null for a null id
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    response_id = _id("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    response = _record(
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), response_id,
        [target, digest, F.lit("Content-Type: application/http;msgtype=response"),
         F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _id("response", "original"))),
         F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        F.concat(http, body), F.octet_length(http) + F.octet_length(body))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    get = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{RECORD_END}"))
    request = _record(F.lit("request"), _id("request"), [target, concurrent, F.lit("Content-Type: application/http;msgtype=request")], get, F.octet_length(get))
    about = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _id("metadata"), [target, concurrent, F.lit("Content-Type: application/warc-fields")], about, F.octet_length(about))
    capture = F.concat_ws(RECORD_END, request, response, metadata)
    small = archive_bytes // records_per_file
    most = slim.agg(F.max("bytes")).first()[0] or 0
    parts = [("small", F.col("bytes") <= small, records_per_file)]
    if most > small:
        parts.append(("large", F.col("bytes") > small, max(1, archive_bytes // most)))
    for name, which, per_file in parts:
        (page.filter(which).select(capture.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
         .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(f"{path}/{name}"))


class _Buffer:
    """The unread part of a stream of byte chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.data = iter(chunks), bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is not None:
            self.data += chunk
        return chunk is not None

    def has(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def find(self, mark: bytes) -> int:
        at, seen = -1, 0
        while (at := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                break
        return at


def parse_records(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record of one archive,
    given whole or in chunks; one record is held at a time.  A broken record
    raises: archives are not skipped silently."""
    left, at = _Buffer([data] if isinstance(data, bytes) else data), 0
    while left.has(1):
        end = left.find(b"\r\n\r\n")
        if not left.data.startswith(b"WARC/") or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in left.data[:end].decode().split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        stop = end + 4 + int(headers["content-length"])
        if not left.has(stop):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, bytes(left.data[end + 4:stop])
        left.has(stop + len(RECORD_END))
        del left.data[:stop + len(RECORD_END)]
        at += stop + len(RECORD_END)


def unpack(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Chunks of the data, out of one or several gzip members; other data is
    given as it is."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    member = None
    for i in range(0, len(data), step):
        piece = data[i:i + step]
        while piece:
            member = member or zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = None
    if member:
        raise ValueError("archive is cut off")


_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()),
                     ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.string())])
RECORD_SCHEMA = "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_bytes bigint, payload_digest string, block string"


def _row(headers: dict, block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    n, digest, text = len(block), None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if f"sha1:{digest}" != headers.get("warc-payload-digest", f"sha1:{digest}"):
                raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
            text = payload.decode("utf-8", "replace") if with_payload else None
        else:  # the stored HTTP header describes the full payload
            n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
    elif with_payload:
        text = block.decode("utf-8", "replace")
    return (headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), n, digest, text)


def read_records(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 500, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives below ``path``.  A task holds one
    compressed archive, one record and one batch of rows."""

    def parse(batch: pa.RecordBatch):
        for content in batch.column("content"):
            rows, size = [], 0
            for headers, block in parse_records(unpack(content.as_py())):
                rows.append(_row(headers, block, with_payload))
                size += len(block) if with_payload else 0
                if len(rows) >= rows_per_batch or size >= batch_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return common.map_batches(files.select("content"), parse, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response, request, metadata`` structs and
    the numbers of requests and metadata records that name the response."""
    part = lambda kind: (records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("to"))
                         .agg(F.min(F.struct("record_id", "uri", "payload_bytes", "block")).alias(kind), F.count("*").alias(f"n_{kind}")))
    captures = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("to"), F.struct("record_id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "block").alias("response"))
    both = captures.join(part("request"), "to", "left").join(part("metadata"), "to", "left")
    return both.select("response", "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_request"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def page_of(record_id, kind: str):
    """The page id inside a record id, of type ``kind``."""
    return F.nullif(F.url_decode(F.regexp_extract(record_id, "^<urn:x-capture:([^:]*):", 1)), F.lit("")).try_cast(kind)


def captures_of(spark: SparkSession, path: str, id_type: T.DataType | str = "bigint", with_payload: bool = True) -> DataFrame:
    """Archives -> one row per capture with the page id and what it refers to."""
    kind = id_type if isinstance(id_type, str) else id_type.simpleString()
    t = transactions(read_records(spark, path, with_payload))
    return t.select(page_of(F.col("response.record_id"), kind).alias("page_id"), page_of(F.col("response.refers_to"), kind).alias("refers_to"), "*")


def archive_path(spark: SparkSession) -> str:
    """A new folder in the shared folder the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
