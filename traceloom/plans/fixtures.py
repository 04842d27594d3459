"""Files and raw records made of the driver's tables, for the queries of readers and sinks."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import delete_at_exit, drop_table, materialize, new_path


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for Spark's writers."""
    return new_path(spark, name)


def local_file(spark: SparkSession, name: str) -> str:
    """A new file in the shared folder, for formats that are one file; the folder must be mounted on all machines."""
    path = new_path(spark, "file")
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} is not a mounted folder")
    there = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(there)
    delete_at_exit(spark, path)
    return f"{there}/{name}"


def timeline_database(events: Iterator[tuple], path: str) -> None:
    """A timeline database of (id, micros, kind, user) rows."""
    import json
    import sqlite3
    import zlib

    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE event (_timestamp INTEGER, timestamp_desc TEXT, _event_data_row_identifier INTEGER)")
        db.execute("CREATE TABLE event_data (_identifier INTEGER PRIMARY KEY, _data BLOB)")
        for k, micros, kind, user in events:
            raw = json.dumps({"data_type": "events:row", "user": str(user), "_hidden": 1})
            db.execute("INSERT INTO event_data VALUES (?, ?)", (k, zlib.compress(raw.encode()) if k % 2 else raw))
            db.execute("INSERT INTO event VALUES (?, ?, ?)", (micros, kind, k))


def _attribute(kind: int, body: bytes, label: str = "") -> bytes:
    raw = label.encode("utf-16-le")
    at = 24 + len(raw) + (-len(raw) % 8)
    size = at + len(body) + (-(at + len(body)) % 8)
    head = struct.pack("<IIBBHHHIHH", kind, size, 0, len(label), 24, 0, 0, len(body), at, 0)
    return (head + raw).ljust(at, b"\0") + body.ljust(size - at, b"\0")


def file_record(entry: int, parent: int, name: str, created: int, is_dir: bool, content: bytes) -> bytes:
    """A file-table record of 1024 bytes whose $SI times are `created` and whose $FN creation is one tick later."""
    attrs = _attribute(0x10, struct.pack("<QQQQI", created, created, created, created, 32).ljust(72, b"\0"))
    named = parent.to_bytes(6, "little") + struct.pack("<H", 1) + struct.pack("<QQQQ", created + 1, created, created, created)
    attrs += _attribute(0x30, named.ljust(56, b"\0") + b"".rjust(8, b"\0") + bytes([len(name), 1]) + name.encode("utf-16-le"))
    attrs += _attribute(0x80, content)
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 12345, 1, 1, 56, 1 | 2 * is_dir, 0, 1024, 0, 0, 0, entry)
    data = bytearray((head + b"\x07\x00" + b"\0" * 6 + attrs + b"\xff" * 4).ljust(1024, b"\0"))
    for k in (1, 2):
        data[48 + 2 * k : 50 + 2 * k] = data[k * 512 - 2 : k * 512]
        data[k * 512 - 2 : k * 512] = b"\x07\x00"
    return bytes(data)


def file_records(rows: DataFrame) -> DataFrame:
    """(raw) of rows (entry, parent, name, created, is_dir, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"raw": [file_record(int(e), int(p), n, int(c), bool(d), t.encode()) for e, p, n, c, d, t in pdf[["entry", "parent", "name", "created", "is_dir", "content"]].itertuples(index=False)]})

    return rows.mapInPandas(run, "raw binary")


def _journal_records(pdf: pd.DataFrame) -> bytes:
    """Version-2 records of rows (usn, entry, ticks, bits, name), one after the other."""
    out = []
    for usn, entry, ticks, bits, name in pdf[["usn", "entry", "ticks", "bits", "name"]].itertuples(index=False):
        raw = name.encode("utf-16-le")
        size = 60 + len(raw) + (-(60 + len(raw)) % 8)
        head = struct.pack("<IHHQQQQIIIIHH", size, 2, 0, (1 << 48) | int(entry), (1 << 48) | 5, int(usn), int(ticks), int(bits), 0, 0, 32, len(raw), 60)
        out.append((head + raw).ljust(size, b"\0"))
    return b"".join(out)


def journals(rows: DataFrame) -> DataFrame:
    """(content): a journal of version-2 records for each `journal` of rows (journal, usn, entry, ticks, bits, name)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [b"\0" * 64 + _journal_records(pdf.sort_values("usn"))]})

    return rows.groupBy("journal").applyInPandas(run, "content binary")


def write_journals(rows: DataFrame, folder: str) -> None:
    """A file `<journal>.usn` in a folder for each journal of rows, whose pieces are made and written to their places by tasks.

    A piece is a batch of rows in order; the sums of the pieces' sizes are their places, after 64 empty bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for journal, some in pdf.groupby("journal"):
                yield pd.DataFrame({"journal": [journal], "first": [some["usn"].iloc[0]], "piece": [_journal_records(some)]})

    def write(pieces: Iterator) -> None:
        for r in pieces:
            with open(f"{folder}/{r['journal']}.usn", "r+b") as f:
                f.seek(r["place"])
                f.write(r["piece"])

    os.makedirs(folder, exist_ok=True)
    ordered = rows.repartitionByRange("journal", "usn").sortWithinPartitions("journal", "usn")
    pieces = materialize(ordered.mapInPandas(run, "journal long, first long, piece binary"), "journal-pieces")
    sizes = pieces.select("journal", "first", F.length("piece").alias("size"))
    before = Window.partitionBy("journal").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each piece
    places = sizes.select("journal", "first", (F.coalesce(F.sum("size").over(before), F.lit(0)) + 64).alias("place"))
    for r in sizes.select("journal").distinct().collect():
        with open(f"{folder}/{r['journal']}.usn", "wb") as f:
            f.truncate(64)
    pieces.join(F.broadcast(places), ["journal", "first"]).foreachPartition(write)
    drop_table(pieces)


def event_log(users):
    """A log with a record per (id, user): the first holds the template, the others refer to it; the last is damaged."""
    chunk, utf = bytearray(b"ElfChnk\0".ljust(512, b"\0")), lambda x: x.encode("utf-16-le")
    template, known = 0, {}

    def named(at, text):
        if text in known:
            return struct.pack("<I", known[text])
        known[text] = at + 4
        return struct.pack("<IIHH", at + 4, 0, 0, len(text)) + utf(text) + b"\0\0"

    def body(base):
        out = b"\x0f\x01\x01\x00"

        def start(tag, more=False):
            nonlocal out
            out += bytes([0x41 if more else 0x01]) + b"\0\0" + b"\0" * 4
            out += named(base + len(out), tag) + (b"\0" * 4 if more else b"")

        def attribute(name, value):
            nonlocal out
            out += b"\x06"
            out += named(base + len(out), name) + value

        def text(x):
            return b"\x05\x01" + struct.pack("<H", len(x)) + utf(x)

        start("Event")
        out += b"\x02"
        start("System")
        out += b"\x02"
        start("Provider", True)
        attribute("Name", text("P&Q"))
        out += b"\x03"
        start("EventID")
        out += b"\x02" + b"\x0d\x00\x00\x06" + b"\x04"
        start("TimeCreated", True)
        attribute("SystemTime", b"\x0d\x01\x00\x11")
        out += b"\x03"
        start("EventRecordID")
        out += b"\x02" + b"\x0d\x02\x00\x0a" + b"\x04" + b"\x04"
        start("EventData")
        out += b"\x02"
        start("Data", True)
        attribute("Name", text("User"))
        out += b"\x02" + b"\x0e\x03\x00\x01" + b"\x04"
        start("Data", True)
        attribute("Name", text("Sid"))
        out += b"\x02" + b"\x0e\x04\x00\x13" + b"\x04"
        return out + b"\x04\x04\x00"

    for k, user in enumerate(users):
        at = len(chunk) + 24
        head, sid = b"\x0f\x01\x01\x00", bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544)
        if not template:
            template = at + 14
            inside = body(template + 24)
            define = b"\0" * 20 + struct.pack("<I", len(inside)) + inside
        else:
            define = b""
        values = [(6, struct.pack("<H", 4624)), (0x11, struct.pack("<Q", 133498026000000000 + k)), (10, struct.pack("<Q", k)), (1, utf(user)), (0x13, sid)]
        xml = head + b"\x0c\x01" + struct.pack("<II", 0, template) + define + struct.pack("<I", len(values))
        xml += b"".join(struct.pack("<HBB", len(v), t, 0) for t, v in values) + b"".join(v for _, v in values) + b"\0"
        size = 28 + len(xml)
        chunk += b"**\0\0" + struct.pack("<IQQ", size, k, 0) + xml + struct.pack("<I", size)
    chunk += b"**\0\0" + struct.pack("<IQQ", 40, 99, 0) + b"\x3f" * 12 + struct.pack("<I", 40)
    return b"ElfFile\0".ljust(4096, b"\0") + bytes(chunk).ljust(65536, b"\0") + b"junk".ljust(65536, b"\0")


def compound(stream, large):
    """A compound file that holds one stream, as sectors (large) or in the short-sector stream."""
    header = bytearray(b"\xff" * 512)
    header[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    size = max(len(stream), 4096) if large else len(stream)
    body = stream.ljust(-(-size // 512) * 512, b"\0")
    n, end = len(body) // 512, 0xFFFFFFFE
    fat = [0xFFFFFFFD, end, end] + [k + 1 for k in range(3, 2 + n)] + [end]
    short = [k + 1 for k in range(len(body) // 64 - 1)] + [end]
    header[24:76] = struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, end if large else 2, 0 if large else 1, end, 0)
    header[76:80] = struct.pack("<I", 0)

    def entry(name, kind, start, length):
        raw = (name + "\0").encode("utf-16-le")
        return (raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind)).ljust(116, b"\0") + struct.pack("<IQ", start, length)

    folder = entry("Root Entry", 5, end if large else 3, 0 if large else len(body)) + entry("Workbook", 2, 3 if large else 0, size)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    return bytes(header) + table + folder.ljust(512, b"\0") + struct.pack(f"<{len(short)}I", *short).ljust(512, b"\xff")[:512] + body


def workbook():
    rec = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    cell = lambda r, c, xf=0: struct.pack("<HHH", r, c, xf)
    label = lambda x: struct.pack("<HB", len(x), 0) + x.encode("latin-1")
    # Shared strings: the second goes on in a further part with wide letters; the third has a run of formats.
    first = struct.pack("<II", 3, 3) + label("name") + struct.pack("<HB", 4, 0) + b"ab"
    more = b"\x01" + "cд".encode("utf-16-le") + struct.pack("<HBH", 1, 8, 1) + b"z" + b"\0" * 4
    glob = rec(0x809, b"\0" * 16) + rec(0x41E, struct.pack("<H", 164) + label("yyyy\\-mm")) + rec(0xE0, b"\0" * 20) + rec(0xE0, struct.pack("<HH", 0, 14).ljust(20, b"\0")) + rec(0xE0, struct.pack("<HH", 0, 164).ljust(20, b"\0"))
    tail = rec(0xFC, first) + rec(0x3C, more) + rec(0x0A)
    at = len(glob) + len(rec(0x85, struct.pack("<IBBBB", 0, 0, 0, 2, 0) + b"S1")) + len(tail)
    glob += rec(0x85, struct.pack("<IBBBB", at, 0, 0, 2, 0) + b"S1") + tail
    rows = rec(0xFD, cell(0, 0) + struct.pack("<I", 0)) + rec(0x204, cell(0, 1) + label("when")) + rec(0x204, cell(0, 3) + label("name"))
    rows += rec(0xFD, cell(1, 0) + struct.pack("<I", 1)) + rec(0x203, cell(1, 1, 1) + struct.pack("<d", 45566.5)) + rec(0x27E, cell(1, 2) + struct.pack("<I", (1234 << 2) | 3))
    rows += rec(0x06, cell(2, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + rec(0x207, label("made")) + rec(0x203, cell(2, 1, 2) + struct.pack("<d", 45566.0)) + rec(0x205, cell(2, 2) + b"\x01\x00") + rec(0x205, cell(2, 3) + b"\x07\x01")
    rows += rec(0xBD, struct.pack("<HH", 3, 1) + struct.pack("<HI", 0, (7 << 2) | 2) + struct.pack("<HI", 0, 0xFFFFFFF8 | 2) + struct.pack("<H", 2)) + rec(0xFD, cell(3, 0) + struct.pack("<I", 2))
    return glob + rec(0x809, b"\0" * 16) + rows + rec(0x0A)
