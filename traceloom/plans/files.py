"""Queries of readers, sinks and saved state: files are written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import annotate
from ..operators.filters import QuerySpec, col
from ..operators.ntfs import parent_paths
from ..sources import artifacts, delimited, layouts, sinks
from ..storage import materialize
from ..streaming.windows import stream_histogram
from . import fixtures
from .detections import cases, cases_sql, values
from .registry import query, read

# Delimited text.


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark, d):
    path = fixtures.folder(spark, "csv")
    sinks.export_text(read(spark, d, "documents"), path, columns=["doc_id", "text", "lang"])
    return delimited.read_delimited(spark, path)


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, coalesce(role, '') AS role, regexp_replace(coalesce(text, ''), '[\\t\\r\\n]+', ' ', 'g') AS text FROM conversations")
def tsv_round_trip(spark, d):
    path = fixtures.folder(spark, "tsv")
    sinks.export_text(read(spark, d, "conversations"), path, "\t", columns=["conv_id", "role", "text"])
    return delimited.read_delimited(spark, path)


@query("SELECT p_partkey::VARCHAR AS key, 'x' || p_name || ',' || p_brand AS joined, p_type AS kind FROM part")
def exact_quotes(spark, d):
    """Quotes that open inside a field: x"name,brand",kind."""
    path = fixtures.folder(spark, "quotes")
    parts = read(spark, d, "part")
    lines = parts.select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('x"'), "p_name", F.lit(","), "p_brand", F.lit('"')), "p_type").alias("value"))
    spark.createDataFrame([("key,joined,kind",)], "value string").unionByName(lines).coalesce(1).write.text(path)
    return delimited.read_delimited(spark, path)


@query(r"SELECT doc_id, regexp_replace(text, '[ \t\r\n\f\v]*[\r\n]+[ \t\r\n\f\v]*', ' ', 'g') AS text FROM documents")
def unwrapped_fields(spark, d):
    return read(spark, d, "documents").select("doc_id", delimited.unwrap(F.col("text")).alias("text"))


_SHEET = [("abc\u0434", "2024-10-01 12:00:00", "12.34", ""), ("made", "2024-10-01 00:00:00", "TRUE", "#DIV/0!"), ("z", "7", "-2", "")]


@query(f"SELECT name, \"when\", \"Column_3\", name_1 FROM {values(_SHEET, 'name, ' + chr(34) + 'when' + chr(34) + ', ' + chr(34) + 'Column_3' + chr(34) + ', name_1')}")
def xls_read(spark, d):
    """A legacy workbook made by hand: shared strings, dates, packed numbers, formulas, errors."""
    path = fixtures.local_file(spark, "a.xls")
    with open(path, "wb") as f:
        f.write(fixtures.compound(fixtures.workbook(), large=True))
    return artifacts.load(spark, path)


@query("SELECT n_nationkey::VARCHAR AS \"RecordId\", '4624' AS \"EventID\", 'P&amp;Q' AS \"Provider\", '2024-01-15 14:30:00.' || lpad(n_nationkey::VARCHAR, 7, '0') AS datetime, n_name AS \"user\", 'S-1-5-32-544' AS sid FROM nation")
def event_log_read(spark, d):
    """A binary event log with a record a nation: the first holds the template that the others refer to."""
    path = fixtures.local_file(spark, "a.evtx")
    with open(path, "wb") as f:
        f.write(fixtures.event_log([r[0] for r in read(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]))
    return artifacts.load(spark, path).select("RecordId", "EventID", "Provider", "datetime", F.col("data")["User"].alias("user"), F.col("data")["Sid"].alias("sid"))


@query("SELECT event_id, lower(printf('%02x%02x%02x%02x-0000-0000-%04x-000000000000', event_id // 16777216 % 256, event_id // 65536 % 256, event_id // 256 % 256, event_id % 256, user_id % 65536)) AS guid FROM events")
def guid_text(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    little = F.unhex(F.concat(*[F.lpad(F.hex(F.floor(k / 256**i).cast("long") % 256), 2, "0") for i in range(4)], F.lit("00000000"), F.lpad(F.hex(u % 65536), 4, "0"), F.lit("000000000000")))
    return read(spark, d, "events").select("event_id", T.guid(little).alias("guid"))


_FORMATS = [("a.XLSX", "xlsx"), ("b.xlsm", "xlsx"), ("c.xls", "xls"), ("d.evtx", "evtx"), ("e.plaso", "plaso"), ("f.mft", "mft"), ("$J", "usn"), ("x_$J", "usn"), ("g.csv", "csv"), ("h.txt", "csv")]


def _each(function):
    """A function of one text as a column function."""
    return F.pandas_udf(lambda texts: texts.map(function), "string")


@query(f"SELECT event_id, name, kind FROM {cases_sql(_FORMATS, 'name, kind')}")
def format_dispatch(spark, d):
    """A file name for each event, and the reader it would get."""
    kind = _each(lambda n: delimited.detect_format(f"/nowhere/{n}"))
    return cases(spark, d, _FORMATS, "name string, want string").select("event_id", "name", kind("name").alias("kind"))


@query("SELECT DISTINCT url AS ioc FROM pages WHERE trim(url) <> ''")
def ioc_list_read(spark, d):
    """A table of indicators under one of the known headers."""
    path = fixtures.folder(spark, "iocs")
    urls = read(spark, d, "pages").where("trim(url) <> ''").select(F.lit("note").alias("note"), F.col("url").alias("Indicator")).distinct()
    sinks.export_text(urls, path)
    return delimited.read_ioc_list(spark, path)


_KINDS = [("o_orderkey", "numeric"), ("o_orderdate", "timestamp"), ("o_orderpriority", "text"), ("o_totalprice", "numeric"), ("o_orderstatus", "text")]


@query(f"SELECT \"column\", kind FROM {values(_KINDS, chr(34) + 'column' + chr(34) + ', kind')}")
def import_typing(spark, d):
    return A.infer_types(read(spark, d, "orders").select(*[col(c).cast("string").alias(c) for c, _ in _KINDS]))


@query("SELECT count(*) AS rows, 0::BIGINT AS first_id, count(*) - 1 AS last_id, 'csv' AS source_format, 'ts' AS ts_columns, 'event_id,user_id,value' AS numeric_columns FROM events")
def timeline_load(spark, d):
    path = fixtures.folder(spark, "timeline")
    sinks.export_text(read(spark, d, "events"), path, columns=["event_id", "ts", "user_id", "event_type", "value"])
    loaded = artifacts.load_timeline(spark, path)
    found = loaded.df.agg(F.count(F.lit(1)).alias("rows"), F.min("_rowid").alias("first_id"), F.max("_rowid").alias("last_id"))
    return found.select("*", F.lit(loaded.source_format).alias("source_format"), F.lit(",".join(loaded.ts_columns)).alias("ts_columns"), F.lit(",".join(loaded.numeric_columns)).alias("numeric_columns"))


# Spreadsheets.


def _workbook(spark, d, sheet_rows: int) -> str:
    path = fixtures.local_file(spark, "x.xlsx")
    sinks.export_xlsx(read(spark, d, "supplier").select("s_suppkey", "s_name"), path, sheet_rows)
    return path


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def xlsx_round_trip(spark, d):
    return artifacts.load(spark, _workbook(spark, d, sinks.SHEET_ROWS))


@query("SELECT CASE WHEN k = 0 THEN 'Export' ELSE 'Export ' || (k + 1) END AS name, (k + 1)::VARCHAR AS id, CAST(least(7, n - 7 * k) + 1 AS INTEGER) AS rows FROM (SELECT count(*) AS n FROM supplier), range(0, 100000) r(k) WHERE k < ceil(n / 7.0)")
def sheet_listing(spark, d):
    return spark.createDataFrame(artifacts.sheets(_workbook(spark, d, 7)), "name string, id string, rows int")


# Timeline databases and event logs.


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS datetime, event_type AS timestamp_desc, 'events:row' AS data_type, user_id::VARCHAR AS \"user\", 1 AS names FROM events")
def timeline_database(spark, d):
    path = fixtures.local_file(spark, "t.plaso")
    rows = read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_type", "user_id")
    fixtures.timeline_database(rows.toLocalIterator(), path)
    return artifacts.load(spark, path).select("datetime", "timestamp_desc", "data_type", F.col("data")["user"].alias("user"), F.size("data").alias("names"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS datetime, event_id::VARCHAR AS "RecordId", (4624 + user_id % 3)::VARCHAR AS "EventID", 'Microsoft-Windows-Sysmon' AS "Provider", 'Sysmon' AS short,
CASE user_id % 3 WHEN 0 THEN 'LogAlways' WHEN 1 THEN 'Critical' ELSE 'Error' END AS "Level", 'Security' AS "Channel", 'h' || user_id AS "Computer", '<' || event_type || '&>' AS kind, props AS param2, user_id || ' did ' || event_type || ' ' AS message FROM events""")
def event_xml_fields(spark, d):
    e = read(spark, d, "events")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    number = lambda c: c.cast("string")
    xml = F.concat(
        F.lit("<Event><System><Provider Name='Microsoft-Windows-Sysmon'/><EventID Qualifiers='0'>"), number(F.col("user_id") % 3 + 4624), F.lit("</EventID><Level>"), number(F.col("user_id") % 3),
        F.lit("</Level><TimeCreated SystemTime='"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z'/><EventRecordID>"), number(F.col("event_id")),
        F.lit("</EventRecordID><Channel>Security</Channel><Computer>h"), number(F.col("user_id")), F.lit("</Computer></System><EventData><Data Name='Kind'>"),
        escaped(F.concat(F.lit("<"), "event_type", F.lit("&>"))), F.lit("</Data><Data>"), escaped(F.col("props")), F.lit("</Data></EventData></Event>"),
    )
    out = artifacts.event_xml(e.select("event_type", "user_id", xml.alias("xml")).withColumn("x", F.col("xml")), "xml")
    told = artifacts.message(F.lit("%1 did %2%n"), F.array(F.regexp_extract("Computer", r"h(\d+)", 1), F.regexp_extract(F.col("data")["Kind"], "<(.*)&>", 1)))
    return out.select("datetime", "RecordId", "EventID", "Provider", T.abbreviate_provider(F.col("Provider")).alias("short"), "Level", "Channel", "Computer", F.col("data")["Kind"].alias("kind"), F.col("data")["param2"].alias("param2"), told.alias("message"))


# The file table and the journal.

_TICKS = 133_498_026_000_000_000
_FOLDER = "CASE WHEN p_partkey < 10 OR p_partkey % 10 = 0 THEN 5 ELSE p_partkey // 10 * 10 + 100 END"


def _raw_files(spark, d):
    key = F.col("p_partkey")
    parent = F.when((key < 10) | (key % 10 == 0), F.lit(5)).otherwise(F.floor(key / 10) * 10 + 100)
    name = F.concat(F.substring("p_name", 1, 40), F.lit("."), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")))
    rows = read(spark, d, "part").select((key + 100).alias("entry"), parent.cast("long").alias("parent"), name.alias("name"), (key * 10_000_000 + _TICKS + key % 2).alias("created"), (key % 10 == 0).alias("is_dir"), F.concat(F.lit("hello "), key.cast("string")).alias("content"))
    return fixtures.file_records(rows.repartition("entry"))  # the table is small for its rows, so it comes as one or two tasks


_NAMED = "n AS (SELECT p_partkey AS k, substring(p_name, 1, 40) || '.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS name FROM part)"


@query(f"""WITH {_NAMED} SELECT (n.k + 100)::VARCHAR AS "EntryNumber", n.name AS "FileName", CASE WHEN n.k < 10 OR n.k % 10 = 0 THEN '.' ELSE '.\\' || f.name END AS "ParentPath", regexp_extract(n.name, '(\\.[^.]+)$', 1) AS "Extension",
CASE WHEN n.k % 10 = 0 THEN 'True' ELSE 'False' END AS "IsDirectory", 'True' AS "SI<FN", CASE WHEN n.k % 2 = 0 THEN 'True' ELSE 'False' END AS "uSecZeros", 'False' AS "Copied", 'Archive' AS "SiFlags",
strftime(to_timestamp(1705329000 + n.k)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.') || '000000' || (n.k % 2) AS "Created0x10", length('hello ' || n.k)::VARCHAR AS "FileSize" FROM n LEFT JOIN n f ON f.k = n.k // 10 * 10""")
def file_table(spark, d):
    parsed = materialize(artifacts.parse_mft(_raw_files(spark, d)), "file-records")  # read by names, paths and the table
    mft = artifacts.merge_extension_names(parsed)
    table = artifacts.mft_table(mft, parent_paths(mft.select("entry", "parent", "name")))
    return table.select("EntryNumber", "FileName", "ParentPath", "Extension", "IsDirectory", "SI<FN", "uSecZeros", "Copied", "SiFlags", "Created0x10", "FileSize")


@query(f"WITH {_NAMED} SELECT k + 100 AS entry, 1 AS seq, (k + 100) || '-1_' || regexp_replace(name, '[/\\\\:*?\"<>|]', '_', 'g') AS file_name, 'hello ' || k AS content FROM n")
def resident_files(spark, d):
    return artifacts.residents(_raw_files(spark, d)).withColumn("content", F.col("content").cast("string"))


@query(f"""SELECT 'f' || user_id || '.txt' AS name, user_id AS entry, 1 AS seq, 5::BIGINT AS parent_entry, event_id * 8 AS usn, CASE event_id % 3 WHEN 0 THEN 'FileCreate' WHEN 1 THEN 'DataExtend|Close' ELSE '0' END AS reasons,
strftime(to_timestamp(1705329000 + event_id)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.') || '0000003' AS ts FROM events""")
def journal_table(spark, d):
    k = F.col("event_id")
    bits = F.when(k % 3 == 0, F.lit(0x100)).when(k % 3 == 1, F.lit(0x80000002)).otherwise(F.lit(0))
    rows = read(spark, d, "events").select((k % 4).alias("journal"), (k * 8).alias("usn"), F.col("user_id").alias("entry"), (k * 10_000_000 + _TICKS + 3).alias("ticks"), bits.cast("long").alias("bits"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".txt")).alias("name"))
    return artifacts.parse_journal(fixtures.journals(rows), at_once=1000).select("name", "entry", "seq", "parent_entry", "usn", "reasons", "ts")


@query("""SELECT 'f' || user_id || '.txt' AS name, user_id AS entry, event_id * 8 AS usn, CASE event_id % 3 WHEN 0 THEN 'FileCreate' WHEN 1 THEN 'DataExtend|Close' ELSE '0' END AS reasons, event_id % 2 AS journal FROM events""")
def journal_ranges(spark, d):
    """Two large journal files, each read in ranges of 8 kB by as many tasks."""
    from ..sources.journal_source import read_journal

    k = F.col("event_id")
    bits = F.when(k % 3 == 0, F.lit(0x100)).when(k % 3 == 1, F.lit(0x80000002)).otherwise(F.lit(0))
    rows = read(spark, d, "events").select((k % 2).alias("journal"), (k * 8).alias("usn"), F.col("user_id").alias("entry"), (k * 10_000_000 + _TICKS).alias("ticks"), bits.cast("long").alias("bits"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".txt")).alias("name"))
    folder = fixtures.local_file(spark, "journals")
    fixtures.write_journals(rows, folder)
    found = read_journal(spark, folder, split_bytes=8192)
    return found.select("name", "entry", "usn", "reasons", F.regexp_extract("file", r"([01])\.usn$", 1).cast("long").alias("journal"))


# Reports and saved state.


def _marks(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("_rowid"), "ts", "event_type", F.lit("").alias("note"))
    return rows, e.where("event_id % 50 = 0").select(F.col("event_id").alias("rowid")), e.where("event_id % 70 = 0").select(F.col("event_id").alias("rowid"), F.col("event_type").alias("tag"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 50 = 0) AS bookmarked, CAST(count(DISTINCT event_type) FILTER (WHERE event_id % 70 = 0) AS INTEGER) AS tags, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
CAST(count(*) FILTER (WHERE event_id % 50 = 0) + count(*) FILTER (WHERE event_id % 70 = 0) AS INTEGER) AS listed, 'malicious,clean' AS verdicts FROM events""")
def report_sections(spark, d):
    """What an HTML report of all marked rows says: totals, span, sections, and verdicts with the worst first."""
    verdicts = spark.createDataFrame([("b.org", "clean", 0.0), ("a.org", "malicious", 0.4)], "ioc string, verdict string, score double")
    path = fixtures.folder(spark, "report")
    sinks.write_report(path, *_marks(spark, d), "ts", verdicts=verdicts)
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("at"))
    heading = lines.where(F.col("value").contains("<h2>Verdicts</h2>")).agg(F.min("at").alias("split"))
    said = lines.crossJoin(F.broadcast(heading))  # one row
    top, value, late = r"<p>(\d+) rows, (\d+) bookmarked, (\S+ [\d:]+)", F.col("value"), F.col("at") > F.col("split")
    total = lambda k: F.max(F.when(value.rlike(top), F.regexp_extract(value, top, k)))
    named = F.when(late & value.rlike("<td>(malicious|clean)</td>"), F.struct("at", F.regexp_extract(value, "<td>(malicious|clean)</td>", 1).alias("verdict")))
    return said.agg(
        total(1).cast("long").alias("rows"), total(2).cast("long").alias("bookmarked"), F.sum(F.regexp_count(value, F.lit("<li>"))).cast("int").alias("tags"), total(3).alias("first_ts"),
        F.sum(F.when(~late, F.regexp_count(value, F.lit("<tr><td>")))).cast("int").alias("listed"), F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda v: v["verdict"]), ",").alias("verdicts"),
    )


@query("SELECT CAST(ceil(count(*) / 60.0) AS INTEGER) AS pages FROM customer")
def report_pages(spark, d):
    names = [r[0] for r in read(spark, d, "customer").select("c_name").toLocalIterator()]
    return spark.createDataFrame([(sinks.report_pdf("".join(f"<p>{n}</p>" for n in names), fixtures.local_file(spark, "r.pdf")),)], "pages int")


@query("SELECT event_id, event_id % 50 = 0 AS bookmarked FROM events WHERE event_type IN ('error', 'signup') AND contains(lower(props), '1')")
def session_replay(spark, d):
    """A saved session, loaded again: its filters give the rows, its bookmarks mark them."""
    path = fixtures.local_file(spark, "s.tle")
    marks = [r[0] for r in _marks(spark, d)[1].collect()]
    sinks.Session([sinks.Tab("events", d, filters={"text": {"props": "1"}, "checked": {"event_type": ["error", "signup"]}}, bookmarks=marks)]).save(path)
    tab = sinks.Session.load(path).tabs[0]
    marked = spark.createDataFrame([(b, True) for b in tab.bookmarks], "event_id long, bookmarked boolean")
    rows = QuerySpec(**tab.filters).apply(read(spark, tab.path, "events"))
    return rows.join(marked, "event_id", "left").select("event_id", F.coalesce("bookmarked", F.lit(False)).alias("bookmarked"))


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def filter_preset(spark, d):
    path = fixtures.local_file(spark, "presets.json")
    sinks.save_json(path, [{"name": "urgent", "filters": {"text": {"o_orderpriority": "URGENT"}, "checked": {"o_orderstatus": ["F"]}, "disabled": ["o_orderstatus"]}}])
    chosen = next(p for p in sinks.load_json(path, []) if p["name"] == "urgent")
    return QuerySpec(**chosen["filters"]).apply(read(spark, d, "orders")).select("o_orderkey")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND user_id % 5 = 3) AND NOT contains(props, ': 7')")
def profile_suppression(spark, d):
    """Findings without those that a saved profile calls known good; a rule's reason is not compared."""
    path = fixtures.local_file(spark, "profile.json")
    rules = [{"process": "ERROR.exe", "host": "H3", "reason": "scanner"}, {"command_contains": ": 7", "reason": "backup"}, {"reason": "nothing filled"}]
    sinks.save_json(path, {"version": 1, "suppressions": rules, "baselines": [], "updatedAt": None})
    image = F.concat(F.lit("C:\\x\\"), "event_type", F.lit(".exe"))
    found = read(spark, d, "events").select("event_id", image.alias("image"), F.lit("").alias("parent_image"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"), F.lit("u").alias("user"), F.col("props").alias("command"), F.lit("x").alias("reason"))
    saved = sinks.load_json(path, {})["suppressions"]
    table = spark.createDataFrame([tuple(r.get(c) for c in (*annotate.PROFILE_FIELDS, "reason")) for r in saved], ", ".join(f"{c} string" for c in (*annotate.PROFILE_FIELDS, "reason")))
    return annotate.suppress(found, table).select("event_id")


@query("SELECT event_type || ':' || count(*) AS line FROM events GROUP BY event_type")
def text_save(spark, d):
    path = fixtures.local_file(spark, "notes.txt")
    counts = read(spark, d, "events").groupBy("event_type").count().collect()
    sinks.save_text(path, "\n".join(f"{r[0]}:{r[1]}" for r in counts))
    return spark.read.text("file:" + path).select(F.col("value").alias("line"))


_LAYOUTS = [("EntryNumber,ParentEntryNumber,InUse,x", "MFTECmd"), ("Timestamp,RuleTitle,Level,Computer", "Hayabusa (Standard)"), ("datetime,RecordId,EventID,Provider,Level,Channel,Computer,Message", "Native event log"), ("HivePath,Key,ValueName,ValueData", "RECmd (Registry)"), ("a,b", None)]


@query(f"SELECT event_id, headers, layout FROM {cases_sql(_LAYOUTS, 'headers, layout')}")
def layout_detection(spark, d):
    """A line of headers for each event, and the layout it is known by."""
    layout = _each(lambda h: getattr(layouts.detect_layout(h.split(",")), "name", None))
    return cases(spark, d, _LAYOUTS, "headers string, want string").select("event_id", "headers", layout("headers").alias("layout"))


# Streams (an extension).


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
def stream_histogram_hour(spark, d):
    """The histogram as a stream over files that are there, run until they are read."""
    path = fixtures.folder(spark, "stream")
    read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(path)
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(path)
    name = "histogram_" + path.rsplit("-", 1)[1]
    stream_histogram(events, "ts", "1 hour", "60 days", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", fixtures.folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
