"""Delimited text: format dispatch, header rules, both splitting rules, wrapped fields."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

MAGIC_MFT = b"FILE"


def detect_format(path: str) -> str:
    """xls, xlsx, evtx, plaso, mft, usn or csv, by extension, name and magic; a folder holds text files."""
    name = os.path.basename(path).lower()
    ext = os.path.splitext(name)[1]
    known = {".xls": "xls", ".xlsx": "xlsx", ".xlsm": "xlsx", ".evtx": "evtx", ".plaso": "plaso", ".mft": "mft", ".timeline": "plaso?"}
    if ext in known and known[ext] != "plaso?":
        return known[ext]
    if os.path.isdir(path):
        return "csv"
    if ext == ".timeline":
        with open(path, "rb") as f:
            return "plaso" if f.read(16).startswith(b"SQLite format 3") else "csv"
    if name in ("$j", "j", "usnjrnl", "$usnjrnl", "$usnjrnl_$j", "$usnjrnl%3a$j") or name.endswith("$j"):
        return "usn"
    if not ext or name in ("$mft", "mft"):
        with open(path, "rb") as f:
            return "mft" if f.read(4) == MAGIC_MFT else "csv"
    return "csv"


def delimiter_of(header: str) -> str:
    """The most frequent of tab, pipe and comma; tab has to beat both, pipe has to beat comma."""
    tabs, pipes, commas = (header.count(c) for c in "\t|,")
    return "\t" if tabs > pipes and tabs > commas else "|" if pipes > commas else ","


def header_names(cells: list[str]) -> list[str]:
    """Trimmed names; empty ones are Column; repeated ones get _1, _2, ... until they are new."""
    out: list[str] = []
    for cell in cells:
        base = cell.strip().lstrip("﻿") or "Column"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def split_quoted(record: str) -> list[str]:
    """Fields of a comma record; quotes toggle anywhere and are doubled to stand for themselves."""
    if '"' not in record:
        return record.split(",")
    fields, field, quoted, k = [], [], False, 0
    while k < len(record):
        c = record[k]
        if c == '"':
            if quoted and record[k + 1 : k + 2] == '"':
                field.append('"')
                k += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(field))
            field = []
        else:
            field.append(c)
        k += 1
    return [*fields, "".join(field)]


MOST_BLOCKS = 1_000_000  # blocks whose parities are broadcast: 64 TB in blocks of 64 MB


def _comma_records(lines: DataFrame, header: str, width: int) -> DataFrame:
    """(f): the fields of every comma record; a record ends with the line that leaves no quote open.

    A line's state depends on all quotes before it in its file. So quotes are counted per block of a file first, the sums
    give each block's state at its start, and then every task splits its blocks by itself. Only the pieces of records that
    cross the end of a block are put together afterwards; there are at most two a block, and none if no block has an odd
    number of quotes.
    """
    spark = lines.sparkSession
    at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = at.groupBy("file", "block").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    quotes = materialize(quotes, "quotes")
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = quotes.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    marked = at.join(F.broadcast(starts) if quotes.count() <= MOST_BLOCKS else starts, ["file", "block"]).select("value", "file", "block", "inside")
    schema = pa.schema([("f", pa.list_(pa.string())), ("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("piece", pa.string())])

    def fields_of(record: str) -> list[str] | None:
        record = record.removesuffix("\r")
        return (split_quoted(record) + [""] * width)[:width] if record.strip() and record.removeprefix("\ufeff") != header else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, head = None, [], False, False

        def piece(part: int) -> tuple:
            return None, *now, part, "\n".join(held)

        for batch in batches:
            out: list[tuple] = []
            for value, file, block, starts_inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    if held:
                        out.append(piece(1 if head else 2))
                    now, held, inside, head = (file, block), [], starts_inside, starts_inside
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    if head:
                        out.append(piece(0))
                    elif found := fields_of("\n".join(held)):
                        out.append((found, None, None, None, None))
                    held, head = [], False
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(piece(1 if head else 2), schema, strict=True)], schema=schema)

    found = marked.mapInArrow(run, "f array<string>, file string, block long, part int, piece string")
    whole = found.where("f IS NOT NULL").select("f")
    if quotes.where("odd = 1").isEmpty():
        return whole
    # Of a record over several blocks: its start (2), whole blocks inside it (1), its end (0), in the order of the file.
    order = Window.partitionBy("file").orderBy("block", "part")
    numbered = found.where("f IS NULL").withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(order))
    joined = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "piece"))), lambda x: x["piece"]), "\n").alias("r"))
    split = F.arrow_udf(lambda r: pa.array([fields_of(x) for x in r.to_pylist()], pa.list_(pa.string())), T.ArrayType(T.StringType()))
    return whole.unionByName(joined.select(split("r").alias("f")).where("f IS NOT NULL"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of texts: missing values are '', surplus comma fields are dropped, surplus tab or pipe fields stay in the last.

    Comma records follow split_quoted() and may hold line breaks in quotes; large files are split between tasks. Blank
    records, and lines that repeat the header (each file of a folder has one), are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    first = lines.where(F.trim("value") != "").head(1)
    if not first:
        return spark.createDataFrame([], T.StructType([T.StructField("Column", T.StringType())]))
    header = first[0]["value"].rstrip("\r").lstrip("\ufeff")
    if "\0" in header:
        raise ValueError(f"{path} is not a text file")
    sep = delimiter_of(header)
    names = header_names(split_quoted(header) if sep == "," else header.split(sep))
    if sep == ",":
        cells = _comma_records(lines, header, len(names))
    else:
        body = lines.select(F.regexp_replace("value", "\r$", "").alias("value")).where((F.trim("value") != "") & (F.regexp_replace("value", "^\ufeff", "") != header))
        cells = body.select(F.split("value", "\t" if sep == "\t" else r"\|", len(names)).alias("f"))
    return cells.select(*[F.coalesce(F.try_element_at("f", F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(names)])


def unwrap(text: Column, kind: str = "text") -> Column:
    """Line breaks in a field: text makes one space, join removes them, smart joins at path signs or inside words."""
    if kind == "join":
        return F.regexp_replace(text, r"\s*[\r\n]+\s*", "")
    if kind == "smart":
        joined = F.regexp_replace(text, r"(?<=[\\/:._-])[\r\n]+|[\r\n]+(?=[\\/:._-])|(?<=[A-Za-z0-9])[\r\n]+(?=[A-Za-z0-9])", "")
        return F.regexp_replace(joined, r"\s*[\r\n]+\s*", " ")
    return F.regexp_replace(text, r"\s*[\r\n]+\s*", " ")


IOC_HEADERS = ("ioc", "indicator", "value", "hash", "md5", "sha1", "sha256", "ip", "domain", "url", "address")


def read_ioc_list(spark: SparkSession, path: str) -> DataFrame:
    """(ioc) of a text list, or of a table, spreadsheets too: the column with a known header, else every cell."""
    if path.lower().endswith((".txt", ".ioc")):
        return spark.read.text(path).select(F.trim("value").alias("ioc")).where("ioc <> '' AND NOT startswith(ioc, '#')")
    from .artifacts import load

    table = load(spark, path)
    named = [c for c in table.columns if c.lower() in IOC_HEADERS]
    cells = table.select(F.explode(F.array(*[F.col(f"`{c}`") for c in named[:1] or table.columns])).alias("ioc"))
    if not named:
        cells = cells.unionByName(spark.createDataFrame([(c,) for c in table.columns], "ioc string"))
    return cells.where("ioc <> ''")
