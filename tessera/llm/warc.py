"""WARC archives: write captures, read records back, assemble transactions.

Every capture is three records: a request, a response (or a revisit of an equal
payload) and metadata. Request and metadata name the response in
WARC-Concurrent-To; assembly joins them by it into one nested row a capture.

Files are gzip members, one a record, written by Spark's committed text writer:
lost or repeated tasks leave no half-written and no double records. That writer
ends each row by a separator; it is set to the zero byte that ends a member
(the high byte of its length) and the row leaves that byte out, so files are
plain .warc.gz. Files hold at most RECORDS_PER_FILE captures and about
FILE_BYTES of payload: larger payloads go to files of fewer captures. Reading
inflates one record at a time.

Defined cases: a null payload is empty; rows that repeat page_id, url and html
are one capture, whose `copies` counts them; one page_id with several payloads or urls makes several; null
page_ids are kept; a null url has no target; of equal payloads the largest
(page_id, url) is the response; payloads are whole whatever their length; an
empty table reads back empty; other columns aren't looked at, so their names
can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.llm._shared import BROADCAST_ROWS, cut, slices

RECORDS_PER_FILE = 1_024
#: A file is read as one value, so its bytes are bounded too (a single payload beyond that is a file of its own).
FILE_BYTES = 1 << 28
DATE = "2000-01-01T00:00:00Z"
_STEP = 1 << 14
_MEMBER = 1 << 23  # bytes in a gzip member; must stay under 2**24

_RECORD = "type string, record_id string, concurrent_to string, refers_to string, target string, http_headers string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def record_id(kind: str, page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{page_id}|{url}|{digest}')}>"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _gzip(data: bytes) -> bytes:
    """As gzip members of at most _MEMBER bytes each, so each ends with a zero byte."""
    out = []
    for at in range(0, len(data), _MEMBER):
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        out += [z.compress(data[at : at + _MEMBER]), z.flush()]
    return b"".join(out)


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return _gzip(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def capture_records(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: tuple[int | None, str | None] | None) -> bytes:
    """The three records of one capture. refers: page_id and url of the equal payload's response."""
    digest = base32_sha1(sha1)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    kinds = "revisit" if refers else "response"
    main, request, meta = (record_id(k, page_id, url, digest) for k in ("response", "request", "metadata"))
    path = re.sub(r"^[a-z]+://[^/?#]*", "", target or "") or "/"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("via", target)) if v is not None).encode()
    return b"".join((
        _record([("WARC-Type", "request"), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\n\r\n".encode()),
        _record([("WARC-Type", kinds), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers else None), ("WARC-Refers-To", record_id("response", *refers, digest) if refers else None), ("Content-Type", "application/http; msgtype=response")], http + (b"" if refers else payload)),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields),
    ))


@F.arrow_udf(BinaryType())
def _captures(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Members of captures given by page_id, url, payload, sha1, the response's page_id and url, and whether it is a revisit."""
    for batch in batches:
        for columns in slices(*batch):
            # without the final zero byte, which the writer adds
            yield pa.array([capture_records(i, u, p, s, (ti, tu) if again else None)[:-1] for i, u, p, s, ti, tu, again in zip(*columns)], pa.binary())


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as .warc.gz under path; payloads of at least min_bytes that repeat become revisits."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("key", F.struct("page_id", "url"))
    keyed = rows.where(F.octet_length("payload") >= min_bytes)
    twice = keyed.groupBy("sha1").agg(F.max("key").alias("first"), F.min("key").alias("_least")).where(~F.col("first").eqNullSafe(F.col("_least"))).drop("_least")
    small = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(twice) if small else cut(twice), "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    size = F.octet_length("payload")
    largest = rows.agg(F.max(size)).first()[0] or 0
    least, per_file, mode = 0, RECORDS_PER_FILE, "errorifexists"
    while True:
        most = FILE_BYTES // per_file
        last = per_file == 1 or largest <= most
        above, below = (size > least if least else F.lit(True)), (F.lit(True) if last else size <= most)
        out = joined.where(above & below).select(_captures("page_id", "url", "payload", "sha1", "first.page_id", "first.url", again).alias("members"))
        out.select(F.col("members").cast("string").alias("value")).write.mode(mode).option("lineSep", "\x00").option("maxRecordsPerFile", per_file).text(path)
        if last:
            return
        least, per_file, mode = most, max(1, per_file // 32), "append"


def _members(content: bytes) -> Iterator[bytes]:
    """Inflated records: members are put together until the record's Content-Length is reached."""
    view, at, parts = memoryview(content), 0, b""
    while at < len(view):
        z, found = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            # in small steps: what follows a member is copied each time one ends
            step = view[at : at + _STEP]
            found.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        parts += b"".join(found)
        head = parts.find(b"\r\n\r\n")
        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", parts[: head + 2])[1])
        if len(parts) >= head + 4 + length + 4:
            yield parts
            parts = b""


def parse_record(data: bytes, payloads: bool) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(h["content-length"])]
    kind, http, digest, size, payload, fields = h["warc-type"], None, None, None, None, None
    if kind in ("response", "revisit"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
        if kind == "response":
            digest, size = base32_sha1(hashlib.sha1(payload).hexdigest()), len(payload)
        else:
            digest, size = h["warc-payload-digest"].rpartition(":")[2], int(re.search(r"(?i)content-length: *(\d+)", http)[1])
    elif kind == "request":
        http = block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in block.decode().split("\r\n") if ":" in x)}
    return kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), http, digest, size, payload if payloads else None, fields


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path; without payloads their bytes stay in the reader, sizes and digests don't."""
    columns = [x.split()[0] for x in _RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for content in batch["content"]:
                for data in _members(bytes(content)):
                    rows.append(parse_record(data, payloads))
                    size += 500 + (len(data) if payloads else 0)
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, response (its type tells revisits), copies (pages rows), request, metadata, and refers_to_metadata of the response that a revisit names."""
    inner = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*inner).alias("response"))
    # rows that repeat were written one by one
    main = main.groupBy("capture_id").agg(F.first("response").alias("response"), F.count(F.lit(1)).alias("copies"))

    def side(kind: str) -> DataFrame:
        part = records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target", "http_headers", "fields").alias(kind))
        return part.dropDuplicates(["capture_id"])

    out = main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    # one response may be named by a third of all captures: the named ones alone are joined, broadcast
    # if counted to be few; else from a table, so that skewed partitions can be split
    wanted = records.where(F.col("type") == "revisit").select(F.col("refers_to").alias("capture_id")).distinct()
    named = cut(side("metadata").join(wanted, "capture_id", "left_semi").select(F.col("capture_id").alias("_tsr_to"), F.col("metadata").alias("refers_to_metadata")))
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return out.join(named, F.col("response.refers_to") == F.col("_tsr_to"), "left").drop("_tsr_to")
