"""Readers and writers on small files made here."""

import json
import sqlite3
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.plans import fixtures
from traceloom.sources import artifacts, delimited, eventlog, layouts, legacy_xls, sinks


def collected(df):
    return [tuple(r) for r in df.collect()]


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_headers_and_padding(spark, tmp_path):
    df = delimited.read_delimited(spark, write(tmp_path / "a.csv", "a,a,,b\n1,2\n"))
    assert df.columns == ["a", "a_1", "Column", "b"] and collected(df) == [("1", "2", "", "")]


def test_overflow_differs_by_delimiter(spark, tmp_path):
    assert collected(delimited.read_delimited(spark, write(tmp_path / "t.tsv", "h\ti\nx\ty\tz\n"))) == [("x", "y\tz")]
    assert collected(delimited.read_delimited(spark, write(tmp_path / "c.csv", "h,i\nx,y,z\n"))) == [("x", "y")]


def test_quotes_inside_fields(spark, tmp_path):
    assert collected(delimited.read_delimited(spark, write(tmp_path / "q.csv", 'h,i\nab"c,d"e,2\n'))) == [("abc,de", "2")]


def test_records_over_lines_and_blocks(spark, tmp_path):
    """Random records with quotes and line breaks, read in blocks of a few bytes, against a plain reader of the whole file."""
    import random

    draw, want = random.Random(3), []
    lines = ["a,b,c"]
    for _ in range(120):
        cells = ["".join(draw.choice('xy ,"\n') for _ in range(draw.randrange(12))) for _ in range(3)]
        lines.append(",".join('"' + c.replace('"', '""') + '"' if draw.random() < 0.9 or set(c) & set(',"\n') else c for c in cells))
        if lines[-1].strip():
            want.append(tuple(cells))
    path = write(tmp_path / "m.csv", "\r\n".join(lines) + "\r\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37", "500", str(1 << 27)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = delimited.read_delimited(spark, path)
            assert sorted(collected(df)) == sorted(want) and df.columns == ["a", "b", "c"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_delimiter_and_header_collisions():
    assert delimited.delimiter_of("a\tb,c") == ","
    assert delimited.header_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet='ab,"x ', max_size=6), min_size=1, max_size=5))
def test_quoted_round_trip(cells):
    line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    assert delimited.split_quoted(line) == cells


def test_unwrap(spark):
    df = spark.createDataFrame([("a\nb", "C:\\\nx y", "p\nq")], "t string, s string, j string")
    out = df.select(delimited.unwrap(F.col("t")), delimited.unwrap(F.col("s"), "smart"), delimited.unwrap(F.col("j"), "join")).first()
    assert tuple(out) == ("a b", "C:\\x y", "pq")


def test_spreadsheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a<b"), ("2", None)], "id string, note string")
    path = str(tmp_path / "x.xlsx")
    assert sinks.export_xlsx(df, path) == 2 and artifacts.sheet_names(path) == ["Export"]
    assert sorted(collected(artifacts.load(spark, path))) == [("1", "a<b"), ("2", "")]
    many = spark.range(25).select(F.col("id").cast("string").alias("n"))
    assert sinks.export_xlsx(many, path, sheet_rows=10) == 25 and artifacts.sheets(path) == [("Export", "1", 11), ("Export 2", "2", 11), ("Export 3", "3", 6)]
    assert sorted(int(r[0]) for k in ("Export", "Export 2", "Export 3") for r in collected(artifacts.read_xlsx(spark, path, k))) == list(range(25))
    sinks.export_xlsx(spark.createDataFrame([("n", "x.org")], "note string, IOC string"), path)
    assert collected(delimited.read_ioc_list(spark, path)) == [("x.org",)]


def test_plaso(spark, tmp_path):
    path = str(tmp_path / "t.plaso")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE event (timestamp INTEGER, timestamp_desc TEXT, _event_data_identifier TEXT)")
        db.execute("CREATE TABLE event_data (_identifier INTEGER, _data BLOB)")
        db.execute("INSERT INTO event_data VALUES (1, ?), (2, ?)", (json.dumps({"data_type": "x", "a": 1}), zlib.compress(b'{"data_type": "y", "_b": 2}')))
        db.execute("INSERT INTO event VALUES (1000000, 'd', 'event_data.1'), (0, 'e', 'event_data.2')")
    out = sorted(collected(artifacts.load(spark, path)))
    assert out == [("", "e", "y", {}), ("1970-01-01 00:00:01.000000", "d", "x", {"a": "1"})]


def test_event_xml(spark):
    xml = "<Event><System><Provider Name='P'/><EventID Qualifiers='0'>4624</EventID><Level>4</Level><TimeCreated SystemTime='2024-01-01T00:00:00.1Z'/><EventRecordID>9</EventRecordID><Channel>Security</Channel><Computer>c</Computer></System><EventData><Data Name='User'>a&amp;b</Data><Data>z</Data></EventData></Event>"
    row = artifacts.event_xml(spark.createDataFrame([(xml,)], "xml string")).first()
    assert row["EventID"] == "4624" and row["Level"] == "Information" and row["data"] == {"User": "a&b", "param2": "z"}
    text = spark.range(1).select(artifacts.message(F.lit("u %1%n from %2 %3"), F.array(F.lit("A"), F.lit("B"))).alias("m")).first()["m"]
    assert text == "u A  from B "


def test_event_log(spark, tmp_path):
    (tmp_path / "a.evtx").write_bytes(fixtures.event_log(["u<1>", "", "v"]))
    rows = sorted(artifacts.load(spark, str(tmp_path / "a.evtx")).collect(), key=lambda r: r["RecordId"])
    assert [(r["RecordId"], r["EventID"], r["Provider"], r["datetime"]) for r in rows] == [(str(k), "4624", "P&amp;Q", f"2024-01-15 14:30:00.000000{k}") for k in range(3)]
    assert [r["data"] for r in rows] == [{"User": u, "Sid": "S-1-5-32-544"} for u in ("u<1>", "", "v")]
    (tmp_path / "b.evtx").write_bytes(b"other")
    with pytest.raises(Exception, match="signature"):
        artifacts.load(spark, str(tmp_path / "b.evtx")).collect()


def test_event_values():
    show = eventlog.value_text
    assert show(0x0F, bytes(range(16))) == "{03020100-0504-0706-0809-0A0B0C0D0E0F}" and show(0x14, b"\x2c\x1a\0\0") == "0x1a2c"
    assert show(0x81, "a\0b\0".encode("utf-16-le")) == "a\nb" and show(0x88, struct.pack("<II", 1, 2)) == "1\n2" and show(0x07, struct.pack("<i", -3)) == "-3"
    assert show(0x12, struct.pack("<8H", 2024, 1, 1, 15, 14, 30, 5, 7)) == "2024-01-15T14:30:05.007Z" and show(0x0D, b"\1\0\0\0") == "true" and show(0, b"") == ""


def test_event_user_data(spark):
    xml = "<Event><System><EventID>1149</EventID></System><UserData><E xmlns='x'><Param1>u&amp;v</Param1><Param2></Param2><Param1>w</Param1></E></UserData></Event>"
    row = artifacts.event_xml(spark.createDataFrame([(xml,)], "xml string")).first()
    assert row["EventID"] == "1149" and row["data"] == {"Param1": "u&v", "Param2": ""}


def mft_record(entry, parent, name, si=10**17 * 1, is_dir=False, zone=b"", namespace=1, base=0, extra=()):
    attrs = b""

    def resident(kind, body, label=""):
        raw = label.encode("utf-16-le")
        at = 24 + len(raw) + (-len(raw) % 8)
        size = at + len(body) + (-(at + len(body)) % 8)
        head = struct.pack("<IIBBHHHIHH", kind, size, 0, len(label), 24, 0, 0, len(body), at, 0)
        return (head + raw).ljust(at, b"\0") + body.ljust(size - at, b"\0")

    attrs += resident(0x10, struct.pack("<QQQQI", si, si, si, si, 32).ljust(52, b"\0") + struct.pack("<IQQ", 77, 0, 4096))
    attrs += resident(0x30, parent.to_bytes(6, "little") + struct.pack("<H", 1) + struct.pack("<QQQQ", si + 1, si, si, si).ljust(56, b"\0") + bytes([len(name), namespace]) + name.encode("utf-16-le"))
    attrs += resident(0x80, b"hello")
    if zone:
        attrs += resident(0x80, zone, "Zone.Identifier")
    for kind, body, label in extra:
        attrs += resident(kind, body, label)
    head = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 12345, 1, 1, 56, 1 | 2 * is_dir, 0, 1024, base, 0, 0, entry)
    data = bytearray((head + b"\x07\x00" + b"\0" * 6 + attrs + b"\xff" * 4).ljust(1024, b"\0"))
    for k in (1, 2):
        data[48 + 2 * k : 50 + 2 * k] = data[k * 512 - 2 : k * 512]
        data[k * 512 - 2 : k * 512] = b"\x07\x00"
    return bytes(data)


def test_file_table(spark, tmp_path):
    from traceloom.operators.ntfs import parent_paths

    raw = mft_record(6, 5, "dir", is_dir=True) + mft_record(7, 6, "a.txt", zone=b"[ZoneTransfer]\r\nZoneId=3\r\n") + b"BAAD".ljust(1024, b"\0")
    (tmp_path / "f.mft").write_bytes(raw)
    mft = artifacts.load(spark, str(tmp_path / "f.mft"))
    assert sorted((r["entry"], r["name"], r["size"]) for r in mft.collect()) == [(6, "dir", 5), (7, "a.txt", 5)]
    table = artifacts.mft_table(mft, parent_paths(mft.select("entry", "parent", "name")))
    row = table.where("FileName = 'a.txt'").first()
    assert row["ParentPath"] == ".\\dir" and row["SI<FN"] == "True" and row["HasAds"] == "True" and row["Extension"] == ".txt"
    files = {r["file_name"]: bytes(r["content"]) for r in artifacts.resident_files(spark, str(tmp_path / "f.mft")).collect()}
    assert files["7-1_a.txt"] == b"hello" and "7-1_a.txt_Zone.Identifier" in files


def test_file_table_columns_and_extension_names(spark, tmp_path):
    from traceloom.operators.ntfs import parent_paths

    extra = [(0x40, bytes(range(16)), ""), (0xC0, b"x", "$EFS")]
    raw = mft_record(6, 5, "LONGNA~1", is_dir=True, namespace=2) + mft_record(9, 5, "long name", namespace=1, base=6) + mft_record(10, 5, "posix", namespace=0, base=6)
    raw += mft_record(7, 6, "a.txt", extra=extra) + mft_record(11, 5, "other", namespace=3, base=7)
    (tmp_path / "g.mft").write_bytes(raw)
    mft = artifacts.merge_extension_names(artifacts.load(spark, str(tmp_path / "g.mft")))
    names = mft.where("base = 0").select("entry", "parent", "name")
    rows = {r["EntryNumber"]: r for r in artifacts.mft_table(mft, parent_paths(names)).collect()}
    assert set(rows) == {"6", "7"} and len(rows["6"]) == 33
    assert rows["6"]["FileName"] == "long name" and rows["6"]["NameType"] == "Windows" and rows["6"]["ReferenceCount"] == "1"
    want = {"FileName": "a.txt", "ParentPath": ".\\long name", "SecurityId": "77", "UpdateSequenceNumber": "4096", "LogfileSequenceNumber": "12345", "ObjectIdFileDroid": "03020100-0504-0706-0809-0a0b0c0d0e0f", "LoggedUtilStream": "$EFS", "IsAds": "False", "ReparseTarget": "", "HasAds": "False", "FileSize": "5"}
    assert {k: rows["7"][k] for k in want} == want


def test_layouts():
    assert len(layouts.LAYOUTS) == 28 and len({x.name for x in layouts.LAYOUTS}) == 28
    found = lambda *columns: getattr(layouts.detect_layout(columns), "name", None)
    assert found("EntryNumber", "ParentEntryNumber", "InUse", "z") == "MFTECmd"
    assert found("Timestamp", "RuleTitle", "Level", "Computer") == "Hayabusa (Standard)"
    assert found("Timestamp", "RuleTitle", "Level", "Computer", "Details", "ExtraFieldInfo") == "Hayabusa (Verbose)"
    assert found("Date", "Size", "Type", "Mode", "File Name") == "MacTime (Bodyfile)" and found("a") is None and found() is None
    journal = layouts.detect_layout(["EventId", "Provider", "Channel", "PayloadData1", "Keywords", "TimeCreated"])
    assert journal.color == "Channel" and journal.order(["Keywords", "x", "EventId", "PayloadData1"]) == ["EventId", "PayloadData1", "x"]
    assert all(x.order(x.required) for x in layouts.LAYOUTS)


def test_report_pdf(tmp_path):
    page = "<html><head><title>t</title></head><body><p>1 rows (a\\b)</p><table><tr><th>x</th><th>y</th></tr><tr><td>&lt;1&gt;</td><td>2</td></tr></table></body></html>"
    path = tmp_path / "r.pdf"
    assert sinks.report_pdf(page, str(path)) == 1
    data = path.read_bytes()
    assert data.startswith(b"%PDF-") and data.endswith(b"%%EOF\n") and b"(x | y) Tj" in data and b"(<1> | 2) Tj" in data and rb"(1 rows \(a\\b\)) Tj" in data
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start : start + 4] == b"xref"
    for k, line in enumerate(data[start:].splitlines()[3:8], 1):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj" % k)
    assert sinks.report_pdf("<p>" + "<p>".join(map(str, range(100))), str(path)) == 2 and sinks.report_pdf("", str(path)) == 1


def test_journal(spark, tmp_path):
    name = "a.txt".encode("utf-16-le")
    body = struct.pack("<IHHQQQQIIIIHH", 72, 2, 0, (1 << 48) | 40, (2 << 48) | 5, 100, 133498026000000000, 0x80000100, 0, 0, 32, len(name), 60) + name
    (tmp_path / "$J").write_bytes(b"\0" * 64 + body.ljust(72, b"\0"))
    row = artifacts.load(spark, str(tmp_path / "$J")).first()
    assert (row["name"], row["entry"], row["seq"], row["parent_entry"], row["parent_seq"], row["usn"], row["reasons"]) == ("a.txt", 40, 1, 5, 2, 100, "FileCreate|Close")
    assert row["ts"] == "2024-01-15 14:30:00.0000000"


def test_indicator_list(spark, tmp_path):
    assert sorted(collected(delimited.read_ioc_list(spark, write(tmp_path / "i.txt", "# c\nevil.com\n\n1.2.3.4\n")))) == [("1.2.3.4",), ("evil.com",)]
    assert sorted(collected(delimited.read_ioc_list(spark, write(tmp_path / "i.csv", "note,IOC\na,x.org\n")))) == [("x.org",)]


def test_text_export(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "c,d", "p\tq\nr")], "x string, y string, z string")
    sinks.export_text(df, str(tmp_path / "csv"), one_file=True)
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0] == "x,y,z"
    sinks.export_text(df, str(tmp_path / "tsv"), "\t", one_file=True)
    assert next((tmp_path / "tsv").glob("part-*")).read_text().splitlines()[1].endswith("p q r")


def test_report_session_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024", "a<"), (2, "2025", "")], "_rowid long, ts string, note string")
    out = sinks.report_html(df, spark.createDataFrame([(1,)], "rowid long"), spark.createDataFrame([(2, "T")], "rowid long, tag string"), "ts")
    assert "a&lt;" in out and "T: 1" in out
    none, both = spark.createDataFrame([], "rowid long, tag string"), spark.createDataFrame([(1,), (2,)], "rowid long")
    assert "Bookmarked (first 1 of 2)" in sinks.report_html(df, both, none, "ts", limit=1)
    more = sinks.report_html(df, both, none, "ts", verdicts=spark.createDataFrame([("b", "clean", 0.0), ("a", "malicious", 0.5)], "ioc string, verdict string, score double"))
    assert "Bookmarked (2)" in more and more.index("malicious") < more.index("clean")
    session = sinks.Session([sinks.Tab("t", "p", tags=[[1, "x"]])])
    session.save(str(tmp_path / "s.tle"))
    assert sinks.Session.load(str(tmp_path / "s.tle")) == session
    assert layouts.detect_layout(["datetime", "timestamp_desc", "source", "sourcetype", "z"]).name == "ForensicTimeline"
    assert sinks.load_json(str(tmp_path / "none"), []) == []


@pytest.mark.parametrize("large", [True, False])
def test_legacy_spreadsheet(spark, tmp_path, large):
    (tmp_path / "a.xls").write_bytes(fixtures.compound(fixtures.workbook(), large))
    df = artifacts.load(spark, str(tmp_path / "a.xls"))
    assert df.columns == ["name", "when", "Column_3", "name_1"]
    assert collected(df) == [("abcд", "2024-10-01 12:00:00", "12.34", ""), ("made", "2024-10-01 00:00:00", "TRUE", "#DIV/0!"), ("z", "7", "-2", "")]
    with pytest.raises(ValueError, match="no sheet"):
        legacy_xls.read_xls(spark, str(tmp_path / "a.xls"), "S2")


def test_unsupported(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(b"other")
    with pytest.raises(ValueError, match="signature"):
        artifacts.load(spark, str(tmp_path / "a.xls"))


def test_written_report_has_all_rows_in_order(spark, tmp_path):
    """More rows in a section than a page on the driver shows, in several files; the page of the driver is the same text, cut."""
    df = spark.range(6000).select(F.col("id").alias("_rowid"), F.timestamp_seconds(6000 - F.col("id")).alias("ts"), F.lit("<x>").alias("note"), F.lit("").alias("empty"), (F.col("id") / 4).alias("size"))
    marks, verdicts = df.select(F.col("_rowid").alias("rowid")), spark.createDataFrame([("b", "clean", 0.0), ("a", "malicious", 0.5), ("c", "odd", 0.9)], "ioc string, verdict string, score double")
    tags = marks.where("rowid % 2 = 0").withColumn("tag", F.lit("even"))
    sinks.write_report(str(tmp_path / "page"), df, marks, tags, "ts", verdicts=verdicts)
    page = "".join(p.read_text() for p in sorted((tmp_path / "page").glob("part-*")))
    assert "Bookmarked (6000)" in page and "even (3000)" in page and "<th>empty</th>" not in page
    lines = page.splitlines()
    rows = [x for x in lines if x.startswith("<tr><td>")]
    assert len(rows) == 9003 and rows[0] == "<tr><td>5999</td><td>1970-01-01 00:00:01</td><td>&lt;x&gt;</td><td>1499.75</td></tr>"
    assert [x[8] for x in rows[-3:]] == ["a", "b", "c"] and lines[0].startswith("<!DOCTYPE") and lines[-1] == "</body></html>"
    assert "".join(lines) == sinks.report_html(df, marks, tags, "ts", limit=10_000, verdicts=verdicts)
    assert "Bookmarked (first 5000 of 6000)" in sinks.report_html(df, marks, tags, "ts")


def test_journals_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """Two journals of several pieces each, the same bytes as of journals made whole, and no task makes a whole one."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("journal"), (F.col("id") * 8).alias("usn"), "id", (F.col("id") + 10**17).alias("ticks"), F.lit(256).cast("long").alias("bits"), F.concat(F.lit("f\u00e9"), F.col("id").cast("string")).alias("name")).withColumnRenamed("id", "entry")
    want = {bytes(r["content"]) for r in fixtures.journals(rows).collect()}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(fixtures, "journals", lambda rows: pytest.fail("a whole journal in one group"))
    try:
        fixtures.write_journals(rows.repartition(7), str(tmp_path / "j"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {p.read_bytes() for p in (tmp_path / "j").iterdir()} == want and sorted(p.name for p in (tmp_path / "j").iterdir()) == ["0.usn", "1.usn"]
