"""Exports, reports, sessions and presets."""

from __future__ import annotations

import html
import itertools
import json
import re
import textwrap
import zipfile
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def export_text(df: DataFrame, path: str, sep: str = ",", columns: Sequence[str] | None = None, one_file: bool = False) -> None:
    """Quotes only where comma, quote or line break asks for it; tab files have spaces for tabs and line breaks."""
    shown = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns or df.columns])
    if sep == "\t":
        shown = shown.select(*[F.regexp_replace(F.col(f"`{c}`"), r"[\t\r\n]+", " ").alias(c) for c in shown.columns])
    writer = (shown.coalesce(1) if one_file else shown).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("quote", "\u0000") if sep == "\t" else writer.option("quote", '"').option("escape", '"')).csv(path)


SHEET_ROWS = 1_048_575  # of a sheet, beside its header


def export_xlsx(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> int:
    """Sheets "Export", "Export 2", ... with a bold header and fitted widths; returns the rows, all of which are written.

    Widths come from one aggregation; rows stream from an iterator into the file.
    """
    names = df.columns
    shown = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(names)])
    widest = shown.agg(F.count(F.lit(1)), *[F.coalesce(F.max(F.length(f"c{k}")), F.lit(0)) for k in range(len(names))]).first()
    count, widths = widest[0], [max(len(c), w) for c, w in zip(names, widest[1:], strict=True)]
    cell = lambda v, s=0: f'<c t="inlineStr" s="{s}"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if v is not None else "<c/>"
    cols = "".join(f'<col min="{k}" max="{k}" width="{min(60, max(8, w + 2))}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, sheets = "http://schemas.openxmlformats.org/package/2006", range(1, max(1, -(-count // sheet_rows)) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in sheets)
    listed = "".join(f'<sheet name="Export{"" if k == 1 else f" {k}"}" sheetId="{k}" r:id="rId{k}"/>' for k in sheets)
    linked = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in sheets)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{linked}<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    rows, written = shown.toLocalIterator(), 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
        for k in sheets:
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData><row>{"".join(cell(n, 1) for n in names)}</row>'.encode())
                for row in rows if k == len(sheets) else itertools.islice(rows, sheet_rows):
                    f.write(("<row>" + "".join(cell(v) for v in row) + "</row>").encode())
                    written += 1
                f.write(b"</sheetData></worksheet>")
    return written


def report_lines(df: DataFrame, bookmarks: DataFrame, tags: DataFrame, ts_col: str, id_col: str = "_rowid", limit: int | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(line) of a report, in order: totals, span, tag counts, the bookmarked rows and the rows of each tag, without columns that are empty there.

    A section shows its first `limit` rows (None: all) and says how many it has; all sections come from one join with the marks, and
    their rows are sorted and written as text by tasks. verdicts: (ioc, verdict, score), the worst first.
    """
    spark, tags = df.sparkSession, tags.where("tag IS NOT NULL")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    counts = [(r["tag"], r["count"]) for r in tags.groupBy("tag").count().orderBy("tag").collect()]
    esc = lambda v: html.escape("" if v is None else str(v))
    # All sections from one join: a section is null for the bookmarks, else its tag.
    marks = bookmarks.select("rowid", F.lit(None).cast("string").alias("__tag")).unionByName(tags.select("rowid", F.col("tag").alias("__tag"))).distinct()
    shown = marked = df.join(marks.withColumnRenamed("rowid", id_col), id_col)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("__tag").orderBy(ts_col, id_col))
        shown = marked.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")
    filled = [F.max(F.coalesce(F.col(f"`{c}`") != "" if t == "string" else F.col(f"`{c}`").isNotNull(), F.lit(False))) for c, t in df.dtypes]
    sizes = {r["__tag"]: r["n"] for r in marked.groupBy("__tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = {r[0]: (r[1], [c for c, some in zip(df.columns, r[2:], strict=True) if some]) for r in shown.groupBy("__tag").agg(F.count(F.lit(1)), *filled).collect()}
    fixed = [(0, 0, "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Timeline report</title></head><body>"), (0, 1, f"<p>{totals['n']} rows, {bookmarks.count()} bookmarked, {esc(totals['lo'])} to {esc(totals['hi'])}</p>"), (0, 2, "<ul>" + "".join(f"<li>{esc(t)}: {n}</li>" for t, n in counts) + "</ul>")]
    sections = [("Bookmarked", None), *((t, t) for t, _ in counts)]
    for k, (title, tag) in enumerate(sections, 1):
        (rows, names), count = used.get(tag, (0, [])), sizes.get(tag, 0)
        said = f"{count}" if count == rows else f"first {rows} of {count}"
        fixed += [(k, 0, f"<h2>{esc(title)} ({said})</h2><table><tr>{''.join(f'<th>{esc(c)}</th>' for c in names)}</tr>"), (k, 2, "</table>")]
    last = len(sections) + 1
    if verdicts is not None:
        fixed += [(last, 0, "<h2>Verdicts</h2><table><tr><th>Indicator</th><th>Verdict</th><th>Score</th></tr>"), (last, 2, "</table>")]
    fixed.append((last, 3, "</body></html>"))
    cells = F.udf(lambda row, names: "<tr>" + "".join(f"<td>{esc(row[c])}</td>" for c in names) + "</tr>", "string")
    numbers = spark.createDataFrame([(k, tag, used.get(tag, (0, []))[1]) for k, (_, tag) in enumerate(sections, 1)], "section int, tag string, names array<string>")
    body = shown.join(numbers, F.col("__tag").eqNullSafe(F.col("tag"))).select("section", F.lit(1).alias("part"), F.struct(ts_col, id_col).alias("at"), cells(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "names").alias("line"))
    lines = spark.createDataFrame(fixed, "section int, part int, line string").unionByName(body, allowMissingColumns=True)
    if verdicts is not None:
        rank = F.expr("array_position(array('malicious', 'suspicious', 'clean'), verdict)")
        worst = verdicts.select(F.struct(F.when(rank == 0, 4).otherwise(rank).alias("rank"), F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("less"), "ioc").alias("worst"), "ioc", "verdict", "score")
        listed = worst if limit is None else worst.orderBy("worst").limit(limit)
        lines = lines.unionByName(listed.select(F.lit(last).alias("section"), F.lit(1).alias("part"), "worst", cells(F.struct("ioc", "verdict", "score"), F.array(F.lit("ioc"), F.lit("verdict"), F.lit("score"))).alias("line")), allowMissingColumns=True)
        return lines.orderBy("section", "part", "at", "worst").select("line")
    return lines.orderBy("section", "part", "at").select("line")


def report_html(df: DataFrame, bookmarks: DataFrame, tags: DataFrame, ts_col: str, id_col: str = "_rowid", limit: int = 5000, verdicts: DataFrame | None = None) -> str:
    """The report as one text, for pages that fit the driver; see report_lines()."""
    return "".join(r["line"] for r in report_lines(df, bookmarks, tags, ts_col, id_col, limit, verdicts).collect())


def write_report(path: str, df: DataFrame, bookmarks: DataFrame, tags: DataFrame, ts_col: str, id_col: str = "_rowid", limit: int | None = None, verdicts: DataFrame | None = None) -> None:
    """The report as text files in a folder, whose texts in the order of their names are the page; all rows, unless there is a limit."""
    report_lines(df, bookmarks, tags, ts_col, id_col, limit, verdicts).write.text(path)


def report_pdf(page: str, path: str, width: int = 100, lines_a_page: int = 60) -> int:
    """An HTML report (report_html) as a PDF of plain text; returns the pages. Characters outside Latin-1 become "?".

    Rows of tables become lines with " | " between cells; longer lines are wrapped at `width` characters.
    """
    text = re.sub(r"</t[dh]><t[dh][^>]*>", " | ", page)
    text = re.sub(r"(?s)<head>.*?</head>", "", text)
    text = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:h\d|p|li|tr|table|ul)[^>]*>", "\n", text)))
    lines = [piece for line in text.split("\n") if line.strip() for piece in textwrap.wrap(line.strip(), width)] or [""]
    shown = lambda x: x.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    pages = [lines[k : k + lines_a_page] for k in range(0, len(lines), lines_a_page)]
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, part in enumerate(pages):
        drawn = b"BT /F1 8 Tf 36 800 Td 12 TL\n" + b"".join(b"(" + shown(x) + b") Tj T*\n" for x in part) + b"ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n" % len(drawn) + drawn + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    tail = b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
    with open(path, "wb") as f:
        f.write(bytes(out) + table + tail)
    return len(pages)


@dataclass
class Tab:
    name: str
    path: str
    sheet: str | None = None
    columns: list[str] = field(default_factory=list)
    filters: dict = field(default_factory=dict)
    bookmarks: list[int] = field(default_factory=list)
    tags: list[list] = field(default_factory=list)
    color_rules: list[dict] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)


@dataclass
class Session:
    """Saved tabs; loading one and applying its filters gives lazy plans again."""

    tabs: list[Tab]
    active: int = 0
    version: int = 1

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> Session:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        return cls([Tab(**t) for t in raw["tabs"]], raw["active"], raw["version"])


def save_text(path: str, content: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(content)


def save_json(path: str, value) -> None:
    """Filter presets (a list) and analyst profiles (version, suppressions, baselines, updatedAt)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f)


def load_json(path: str, default):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default
