"""Binary event logs: chunks of records in binary XML, rendered to XML texts that event_xml() turns into columns.

A chunk of 64 KB is self-contained: names and templates are referred to by their offset in it. A record that cannot be
rendered is left out, as is a chunk without its signature. A log is one task's work; the logs of a folder run in parallel.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .artifacts import event_xml

# Fixed values of the format: sizes and signatures, number formats by value type.
FILE_HEADER, CHUNK, CHUNK_HEADER = 4096, 65536, 512
FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\0", b"ElfChnk\0", b"**\0\0"
NUMBERS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}
_ARRAY, _NESTED, _DEPTH = 0x80, 0x21, 32


def _filetime(ticks: int) -> str:
    whole, rest = divmod(ticks, 10_000_000)
    return f"{datetime.datetime(1601, 1, 1) + datetime.timedelta(seconds=whole):%Y-%m-%dT%H:%M:%S}.{rest:07d}Z"


def value_text(kind: int, raw: bytes) -> str:
    """A value as text, not yet escaped; arrays have their items on lines of their own."""
    if kind & _ARRAY:
        item = kind & 0x7F
        if item == 0x01:
            return "\n".join(raw.decode("utf-16-le", "replace").rstrip("\0").split("\0"))
        size = struct.calcsize(NUMBERS[item]) if item in NUMBERS else {0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}.get(item, len(raw) or 1)
        return "\n".join(value_text(item, raw[k : k + size]) for k in range(0, len(raw), size))
    if kind == 0x00 or not raw:
        return ""
    if kind == 0x01:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 0x02:
        return raw.decode("latin-1").rstrip("\0")
    if kind in NUMBERS:
        return str(struct.unpack_from(NUMBERS[kind], raw)[0])
    if kind == 0x0D:
        return "true" if any(raw) else "false"
    if kind == 0x0F:
        return "{" + str(uuid.UUID(bytes_le=raw[:16])).upper() + "}"
    if kind == 0x11:
        return _filetime(struct.unpack_from("<Q", raw)[0])
    if kind == 0x12:
        y, mo, _, d, h, mi, s, ms = struct.unpack_from("<8H", raw)
        return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
    if kind == 0x13:
        parts = struct.unpack_from(f"<{raw[1]}I", raw, 8)
        return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])
    if kind in (0x10, 0x14, 0x15):
        return hex(int.from_bytes(raw, "little"))
    return raw.hex().upper()


class _Chunk:
    """Renders the binary XML of one chunk."""

    def __init__(self, data: bytes):
        self.data = data

    def u(self, form: str, at: int) -> int:
        return struct.unpack_from("<" + form, self.data, at)[0]

    def name(self, at: int) -> tuple[str, int]:
        """The name whose offset stands at `at`, and where reading goes on: past the name if it stands right there."""
        where = self.u("I", at)
        n = self.u("H", where + 6)
        text = self.data[where + 8 : where + 8 + 2 * n].decode("utf-16-le")
        return text, at + 4 + (10 + 2 * n if where == at + 4 else 0)

    def template(self, at: int, depth: int) -> tuple[str, int]:
        """A template instance whose token stands at `at`, rendered with its values, and its end."""
        where, at = self.u("I", at + 6), at + 10
        if where == at:
            at += 24 + self.u("I", where + 20)
        count = self.u("I", at)
        values, place = [], at + 4 + 4 * count
        for k in range(count):
            size, kind = self.u("H", at + 4 + 4 * k), self.data[at + 6 + 4 * k]
            values.append((kind, place, size))
            place += size
        return self.fragment(where + 24, where + 24 + self.u("I", where + 20), values, depth + 1)[0], place

    def shown(self, value: tuple[int, int, int], depth: int) -> str:
        kind, at, size = value
        if kind == _NESTED:
            return self.fragment(at, at + size, [], depth + 1)[0]
        return escape(value_text(kind, self.data[at : at + size]), {"'": "&apos;"})

    def fragment(self, at: int, end: int, values: list, depth: int = 0) -> tuple[str, int]:
        """The XML of the tokens from `at` to the end mark or `end`."""
        if depth > _DEPTH:
            raise ValueError("binary XML is nested too deeply")
        out, tags, attribute = [], [], None  # attribute: the pieces of the attribute that is being read

        def put(text: str) -> None:
            (out if attribute is None else attribute[1]).append(text)

        def close_attribute() -> None:
            nonlocal attribute
            if attribute and (text := "".join(attribute[1])):
                out.append(f" {attribute[0]}='{text}'")
            attribute = None

        while at < end:
            token = self.data[at] & ~0x40
            if token == 0x00:
                return "".join(out), at + 1
            if token == 0x01:
                more = self.data[at] & 0x40
                tag, at = self.name(at + 7)
                at += 4 if more else 0
                tags.append(tag)
                out.append(f"<{tag}")
            elif token in (0x02, 0x03):
                close_attribute()
                out.append(">" if token == 0x02 else "/>")
                if token == 0x03:
                    tags.pop()
                at += 1
            elif token == 0x04:
                out.append(f"</{tags.pop()}>")
                at += 1
            elif token == 0x05:
                size = 2 * self.u("H", at + 2)
                put(escape(self.data[at + 4 : at + 4 + size].decode("utf-16-le", "replace"), {"'": "&apos;"}))
                at += 4 + size
            elif token == 0x06:
                close_attribute()
                name, at = self.name(at + 1)
                attribute = (name, [])
            elif token in (0x07, 0x0B):
                size = 2 * self.u("H", at + 1)
                text = self.data[at + 3 : at + 3 + size].decode("utf-16-le", "replace")
                put(escape(text) if token == 0x07 else f"{text}?>")
                at += 3 + size
            elif token == 0x08:
                put(f"&#{self.u('H', at + 1)};")
                at += 3
            elif token == 0x09:
                name, at = self.name(at + 1)
                put(f"&{name};")
            elif token == 0x0A:
                name, at = self.name(at + 1)
                put(f"<?{name} ")
            elif token == 0x0C:
                text, at = self.template(at, depth)
                put(text)
            elif token in (0x0D, 0x0E):
                k = self.u("H", at + 1)
                put(self.shown(values[k], depth) if k < len(values) else "")
                at += 4
            elif token == 0x0F:
                at += 4
            else:
                raise ValueError(f"unknown token {token} of binary XML")
        return "".join(out), at


def records_of(data: bytes) -> Iterator[str]:
    """The XML of every readable record of a log."""
    if data[:8] != FILE_MAGIC:
        raise ValueError("no event log: the signature is missing")
    for start in range(FILE_HEADER, len(data), CHUNK):
        raw = data[start : start + CHUNK]
        if raw[:8] != CHUNK_MAGIC:
            continue
        chunk, at = _Chunk(raw), CHUNK_HEADER
        while raw[at : at + 4] == RECORD_MAGIC and at + 28 <= len(raw):
            size = chunk.u("I", at + 4)
            if size < 28 or at + size > len(raw):
                break
            try:
                yield chunk.fragment(at + 24, at + size - 4, [])[0]
            except (ValueError, IndexError, KeyError, OverflowError, struct.error):
                pass  # damaged record
            at += size


def read_evtx(spark: SparkSession, path: str) -> DataFrame:
    """The records of one log, or of the logs of a folder, as event_xml() gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                part: list[str] = []
                for text in records_of(content):
                    part.append(text)
                    if len(part) == 5_000:
                        yield pd.DataFrame({"xml": part})
                        part = []
                yield pd.DataFrame({"xml": part}, dtype=object)

    return event_xml(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "xml string"))
