"""WARC archives: writing with revisits and segmentation, reading, and segment reassembly.

Writing: one record per page, an HTTP response with chunked transfer framing. Of pages with equal payloads of at least
`min_revisit` bytes the one with the largest id is the response and the others are revisit records that name it. Blocks
over `segment_bytes` are cut into a first segment and continuation records. Archives are files of WARC records
(gzip'd as a whole), written by Spark's text writer into the shared folder, so any Hadoop store serves and task retries
are safe. Payloads under `min_revisit` bytes meet no join; the others meet the table of repeated payloads, in which each
is there once for each of `salts` salts, so a payload that a third of all rows have is dealt to several tasks.

Reading: a file is decompressed and parsed record by record, so a task holds the compressed file and some records; a file
has at most `file_records` records of at most about `segment_bytes`. Records without segments are complete; segments are grouped by their origin
id (a group is one record's block, whatever the number of records), ordered by segment number, and are valid if the
numbers run from 1 without a gap and the length is the total that the last one states. Chunked framing is then decoded
and the payload's digest compared with the header's.

Defined results: null html is an empty payload; a null id is written as an empty id and read back as null; several rows
with one id and one payload that is the response's are all responses; an empty table makes no records; other columns
are not read. Ids must be integers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_exit, new_path

RECORD_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """A payload in HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(payload), size) if (part := payload[at : at + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError for broken framing. Chunk extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(part)
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def page_records(number: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The WARC records of a page: a response, perhaps in segments, or a revisit."""
    digest, record = hashlib.sha1(payload).hexdigest(), f"<urn:record:{number}>"
    named = "" if page_id is None else page_id
    head = [("WARC-Record-ID", record), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", f"urn:page:{named}"), ("Source-URI", " ".join(url.split()) if url else None), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *head, kind, profile, ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}")], _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *head, kind], block)
        return
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *head, kind, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
        origin = [("WARC-Segment-Origin-ID", record), ("WARC-Segment-Number", k), last]
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{number}:{k}>"), *head[1:3], *origin], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, segment_bytes: int = 1 << 16, file_records: int = 4000, salts: int = 16) -> None:
    """Writes a record per row of pages under path."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("same", F.when(F.col("size") >= min_revisit, F.sha2("payload", 256)))
    groups = rows.where("same is not null").groupBy("same", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = groups.select("same", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    large = rows.where("same is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    repeats = large.join(salted, ["same", "size", "salt"], "left").select("id", "url", "payload", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))
    marked = repeats.unionByName(rows.where("same is null").select("id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in page_records(f"{task}:{row}", page_id, url, body, refers_to, segment_bytes):
                    out.append(record)
                    held += len(record)
                row += 1
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:40]!r} is")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(len(RECORD_END)) != RECORD_END:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block


_PARSED = "record_id string, type string, target string, digest string, refers_to string, origin string, number int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record under path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                raw, rows, held = pa.BufferReader(content.as_buffer()), [], 0
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                for h, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 20)):
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to-target-uri"), h.get("warc-segment-origin-id"), whole(h.get("warc-segment-number")), whole(h.get("warc-segment-total-length")), block))
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _PARSED)


def reassemble(records: DataFrame) -> DataFrame:
    """A row per record with its whole block: (record_id, type, target, digest, refers_to, segments, valid, block).

    valid: the segment numbers run from 1 and the length is the stated total; a group without its first segment has a
    null type. Records without segments pass without a shuffle.
    """
    whole = records.where("number is null").select("record_id", "type", "target", "digest", "refers_to", F.lit(1).alias("segments"), F.lit(True).alias("valid"), "block")
    pieces = records.where("number is not null").withColumn("record_id", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    grouped = pieces.groupBy("record_id").agg(
        *map(first, ("type", "target", "digest", "refers_to")), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    numbers = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    sized = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"])) == F.col("total")
    valid = F.coalesce(numbers & sized, F.lit(False)).alias("valid")
    named = grouped.select("record_id", "type", "target", "digest", "refers_to", F.size("parts").alias("segments"), valid, F.transform("parts", lambda p: p["block"]).alias("blocks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = pa.array([b"".join(x.as_py() for x in parts.values) for parts in batch.column(7)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], blocks], names=[*batch.schema.names[:7], "block"])

    schema = "record_id string, type string, target string, digest string, refers_to string, segments int, valid boolean, block binary"
    return whole.unionByName(named.mapInArrow(joined, schema))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, valid boolean, payload binary"


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per page: payload (null for a revisit), its full length and digest, and whether everything verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda uri: int(uri[9:]) if uri and uri[9:] else None
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for _, kind, target, digest, refers_to, segments, valid, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, _, body = block.partition(RECORD_END)
                fields = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
                payload, found = None, (digest or "").removeprefix("sha1:")
                if kind == "revisit":
                    size = int(fields.get("content-length", 0))
                else:
                    try:
                        payload = dechunk(body) if fields.get("transfer-encoding") == "chunked" else body
                    except ValueError:
                        payload, valid = body, False
                    size, own = len(payload), hashlib.sha1(payload).hexdigest()
                    valid, found = valid and own == found, own
                for column, x in zip(out, (number(target), size, found, kind, number(refers_to), segments, valid, payload if payloads else None), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            names = [x.split()[0] for x in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return reassemble(read_records(spark, path)).mapInArrow(run, _READ)


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages as archives and reads them back, without the payloads."""
    spark = pages.sparkSession
    kept, path = bool(path), path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    if not kept:
        delete_at_exit(spark, path)
    return read_pages(spark, path, payloads=False).drop("payload")
