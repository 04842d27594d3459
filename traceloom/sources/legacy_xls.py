"""Legacy spreadsheets (BIFF8 workbooks in compound files): the cells of one sheet as a table of texts.

Dates are shown as `yyyy-MM-dd HH:mm:ss`; other numbers as in the General format, whatever their own. A sheet has at most
65,536 rows of 256 columns, so one task reads it. Encrypted and older workbooks raise ValueError.
"""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .delimited import header_names

# Fixed values of the formats.
COMPOUND_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
BOF, EOF, CONTINUE, FILEPASS, DATEMODE, BOUNDSHEET, XF, SST, FORMAT = 0x809, 0x0A, 0x3C, 0x2F, 0x22, 0x85, 0xE0, 0xFC, 0x41E
LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def workbook_stream(data: bytes) -> bytes:
    """The workbook's stream in a compound file."""
    if data[:8] != COMPOUND_MAGIC:
        raise ValueError("no legacy spreadsheet: the signature is missing")
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    directory, cutoff, mini_start, mini_count, more, _ = struct.unpack_from("<I4xIIIII", data, 48)
    tables, seen = list(struct.unpack_from("<109I", data, 76)), set()
    while more not in (FREE, END) and more not in seen:
        seen.add(more)
        *found, following = numbers(sector(more))
        tables += found
        more = following
    fat = [n for t in tables if t not in (FREE, END) for n in numbers(sector(t))]

    def chain(start: int, table: list[int], piece) -> bytes:
        out, at, left = [], start, len(table)
        while at < len(table) and left:
            out.append(piece(at))
            at, left = table[at], left - 1
        return b"".join(out)

    entries = chain(directory, fat, sector)
    root, found = None, None
    for k in range(0, len(entries) - 127, 128):
        name = entries[k : k + max(0, struct.unpack_from("<H", entries, k + 64)[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<IQ", entries, k + 116)
        if entries[k + 66] == 5:
            root = start
        elif name.lower() == "workbook":
            found = (start, length & 0xFFFFFFFF)
    if found is None:
        raise ValueError("no workbook of a supported version in this file")
    start, length = found
    if length >= cutoff or root is None:
        return chain(start, fat, sector)[:length]
    small = chain(root, fat, sector)
    table = list(numbers(chain(mini_start, fat, sector))) if mini_count else []
    return chain(start, table, lambda k: small[k * mini : (k + 1) * mini])[:length]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of the records from `at`; the parts after the first are those of CONTINUE records."""
    kind, parts = None, []
    while at + 4 <= len(stream):
        code, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if code == CONTINUE and parts:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = code, [body]
    if kind is not None:
        yield kind, parts


class _Texts:
    """Reads the shared strings, which may go on in further parts; each part starts with the width of its letters."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def _room(self) -> int:
        while self.at >= len(self.parts[self.part]) and self.part + 1 < len(self.parts):
            self.part, self.at = self.part + 1, 0
        return len(self.parts[self.part]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self._room() > 0:
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def text(self) -> str:
        left, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while left:
            if self.at >= len(self.parts[self.part]):
                if not self._room():
                    break
                wide, self.at = self.parts[self.part][0] & 1, 1
            raw = self.parts[self.part][self.at : self.at + left * (1 + wide)]
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            self.at += len(raw)
            left -= len(raw) // (1 + wide)
        self.take(4 * runs + extra)
        return "".join(out)


def _text(raw: bytes) -> str:
    """A string with a 16-bit length, whole in one record."""
    return _Texts([raw]).text()


def _rk(raw: int) -> float:
    value = float(raw - (1 << 32) >> 2 if raw & 0x80000000 else raw >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str]]:
    """The rows of the first sheet, or of the one with this name, as texts; rows between used ones are empty."""
    stream = workbook_stream(data)
    sheets, shared, formats, dates, base = [], [], {}, [], datetime.datetime(1899, 12, 30)
    for kind, parts in _records(stream):
        body = parts[0]
        if kind == FILEPASS:
            raise ValueError("encrypted spreadsheets are not supported")
        if kind == BOUNDSHEET and body[5] == 0:
            wide = body[7] & 1
            sheets.append((body[8 : 8 + body[6] * (1 + wide)].decode("utf-16-le" if wide else "latin-1"), struct.unpack_from("<I", body)[0]))
        elif kind == SST:
            reader = _Texts([body[8:], *parts[1:]])
            shared = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", _text(body[2:]))
        elif kind == XF:
            dates.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == DATEMODE and body[:1] == b"\1":
            base = datetime.datetime(1904, 1, 1)
        elif kind == EOF:
            break
    start = next((at for name, at in sheets if sheet in (None, name)), None)
    if start is None:
        raise ValueError(f"no sheet {sheet}")
    is_date = [n in DATE_FORMATS or bool(re.search("[ymdhs]", formats.get(n, "").replace("General", ""), re.I)) for n in dates]
    cells: dict[tuple[int, int], str] = {}

    def put(row: int, column: int, xf: int, value: float | str) -> None:
        if isinstance(value, float):
            if xf < len(is_date) and is_date[xf]:
                value = (base + datetime.timedelta(seconds=round(value * 86400))).strftime("%Y-%m-%d %H:%M:%S")
            else:
                value = f"{value:.15g}"
        cells[row, column] = value

    pending = None
    for kind, parts in _records(stream, start):
        body = parts[0]
        if kind == EOF:
            break
        if kind == STRING and pending:
            put(*pending, _Texts(parts).text())
        elif kind in (LABELSST, LABEL, NUMBER, RK, FORMULA, BOOLERR):
            where = struct.unpack_from("<HHH", body)
            if kind == LABELSST:
                put(*where, shared[struct.unpack_from("<I", body, 6)[0]])
            elif kind == LABEL:
                put(*where, _text(body[6:]))
            elif kind == RK:
                put(*where, _rk(struct.unpack_from("<I", body, 6)[0]))
            elif kind == BOOLERR:
                put(*where, ERRORS.get(body[6], "#ERR") if body[7] else "TRUE" if body[6] else "FALSE")
            elif kind == FORMULA and body[12:14] == b"\xff\xff":
                pending = where if body[6] == 0 else None
                if body[6] in (1, 2):
                    put(*where, ERRORS.get(body[8], "#ERR") if body[6] == 2 else "TRUE" if body[8] else "FALSE")
            else:
                put(*where, float(struct.unpack_from("<d", body, 6)[0]))
        elif kind == MULRK:
            row, first = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                xf, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                put(row, first + k, xf, _rk(raw))
    if not cells:
        return []
    width = max(c for _, c in cells) + 1
    return [[cells.get((r, c), "") for c in range(width)] for r in range(min(r for r, _ in cells), max(r for r, _ in cells) + 1)]


def read_xls(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet as a table of texts, named by its first row; a sheet of this format has at most 65,536 rows of 256 cells."""
    with open(path, "rb") as f:
        rows = sheet_rows(f.read(), sheet)
    if not rows:
        raise ValueError(f"no data in the sheet of {path}")
    names = header_names([c if c.strip() else f"Column_{k}" for k, c in enumerate(rows[0], 1)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame(pd.DataFrame(rows[1:], columns=names, dtype=object), schema) if len(rows) > 1 else spark.createDataFrame([], schema)
