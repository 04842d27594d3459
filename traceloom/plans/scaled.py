"""Queries of the rule-based operators on tables derived from the driver's: processes, logons, files and findings at size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import annotate, ioc, lateral, ntfs, persistence, process
from ..operators import query as Q
from ..operators.filters import QuerySpec, View, search
from .detections import cases, cases_sql, values
from .registry import query, read

# Search and views.

_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_PADDED = "(' ' || array_to_string(" + _TOKENS + ", ' ') || ' ')"
_TWO = "(contains({0}, {2}) OR contains({1}, {2}))"


def _both(term: str) -> str:
    return _TWO.format(_PADDED.format("p_name"), _PADDED.format("p_type"), f"' {term} '")


@query("SELECT p_partkey FROM part WHERE contains(" + _PADDED.format("replace(p_brand, '#', '.')") + ", ' brand 13 ')")
def search_fts_punctuated(spark, d):
    """A term with punctuation is a phrase of its words."""
    rows = read(spark, d, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit(".")))
    return rows.where(search(["p_name", "p_brand"], "Brand.13", "fts")).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE {_both('widget')} AND {_both('standard')}")
def search_fts_columns(spark, d):
    """Terms that stand in different columns of a row."""
    return read(spark, d, "part").where(search(["p_name", "p_type"], "widget standard", "fts")).select("p_partkey")


@query("WITH w AS (SELECT doc_id, " + _PADDED.format("text") + " AS t FROM documents) SELECT doc_id FROM w WHERE contains(t, ' license ') AND contains(t, ' apache license ')")
def search_fts_phrase_and_word(spark, d):
    return read(spark, d, "documents").where(search(["text", "source"], 'license "Apache License"', "fts")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)Apache(?s:.)License|[0-9]{3}-[0-9]{2}-[0-9]|(?-i:[\[{])(?s:.)')")
def search_regex_dialect(spark, d):
    """A pattern with code points, a named group, a class of everything and brackets in a class."""
    return read(spark, d, "documents").where(search(["text"], r"\u{41}pache[^]License|(?<digits_1>[0-9]{3})-[0-9]{2}-\d|[[{][^]", "regex")).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def filter_toggled(spark, d):
    """Filters and the search that are switched off are not applied."""
    spec = QuerySpec(text={"props": "zzz"}, checked={"event_type": ["error"]}, term="nowhere", disabled=["props"], search_off=True)
    return spec.apply(read(spark, d, "events")).select("event_id")


@query("SELECT count(*) FILTER (WHERE event_type = 'error') AS kept_in, count(*) FILTER (WHERE event_type <> 'error') AS kept_out, count(*) FILTER (WHERE contains(props, '1')) AS found, count(*) AS rows FROM events")
def filtered_totals(spark, d):
    """Totals of views, each counted once and the searches' rows kept."""
    view, plain = View(read(spark, d, "events")), QuerySpec()
    specs = [plain.with_value("event_type", "error"), plain.with_value("event_type", "error", keep=False), QuerySpec(term="1", mode="like", search_columns=["props"]), plain]
    return spark.createDataFrame([tuple(view.total(s) for s in specs for _ in (0,))], "kept_in long, kept_out long, found long, rows long")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:apache license|license|token)')) AS INTEGER) AS spans FROM documents")
def highlight_spans(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(Q.highlight_spans(F.col("text"), ["token", "license", "apache license"])).alias("spans"))


@query("WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS unique_values, CAST(sum(n) AS BIGINT) AS total, count(*) > 100 AS truncated FROM g")
def stack_summary(spark, d):
    return A.stack_summary(read(spark, d, "documents"), "text", 100)


@query("SELECT * FROM (SELECT 'ordered' AS kind, date_trunc('day', o_orderdate)::TIMESTAMP AS bucket, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'due', date_trunc('day', o_orderdate + INTERVAL 36 HOUR)::TIMESTAMP, count(*) FROM orders GROUP BY 2)")
def activity_series(spark, d):
    rows = read(spark, d, "orders").withColumn("due", F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS"))
    return A.activity_series(rows, {"ordered": "o_orderdate", "due": "due"}, "day")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 50")
def tag_like(spark, d):
    events = read(spark, d, "events")
    tags = annotate.add_tags(annotate.tag_filtered(events, F.col("event_type") == "error", "Logon Failure", "event_id"), annotate.tag_filtered(events, F.col("value") > 50, "failing size", "event_id"))
    return annotate.having_tag_like(events.select("event_id"), tags, "FAIL", "event_id")


@query("SELECT DISTINCT event_id AS rowid, tag FROM (SELECT event_id, event_type AS tag FROM events UNION ALL SELECT event_id, 'all' FROM events WHERE event_id % 2 = 0)")
def bulk_tags(spark, d):
    events = read(spark, d, "events")
    one = events.select(F.col("event_id").alias("rowid"), F.col("event_type").alias("tag"))
    return annotate.add_tags(one, one.unionByName(events.where("event_id % 2 = 0").select(F.col("event_id").alias("rowid"), F.lit("all").alias("tag"))))


@query("""SELECT event_id AS rowid, 'Timestomp Indicator' AS tag FROM events WHERE event_id % 11 = 0 UNION SELECT event_id, 'Encrypted' FROM events WHERE event_type = 'error' UNION SELECT event_id, 'Downloaded' FROM events WHERE event_id % 13 = 0
UNION SELECT event_id, 'Ransom Note' FROM events WHERE event_id % 17 = 0 UNION SELECT event_id, 'Payload' FROM events WHERE event_id % 19 = 0 UNION SELECT event_id, 'Created Burst' FROM events WHERE event_id % 23 = 0 UNION SELECT event_id, 'Modified Burst' FROM events WHERE event_id % 29 = 0
UNION SELECT event_id, 'IOC: ' || event_type FROM events WHERE event_id % 7 = 0 UNION SELECT event_id, 'VT: Malicious' FROM events WHERE event_id % 5 = 0 UNION SELECT event_id, 'VT: Clean' FROM events WHERE event_id % 5 = 1""")
def auto_tags(spark, d):
    events = read(spark, d, "events")
    every = lambda n, k=0: events.where(F.col("event_id") % n == k).select(F.col("event_id").alias("rowid"), "event_type")
    verdicts = every(5).withColumn("verdict", F.lit("malicious")).unionByName(every(5, 1).withColumn("verdict", F.lit("clean"))).unionByName(every(5, 2).withColumn("verdict", F.lit("not_found")))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("rowid"))
    return annotate.auto_tags(every(7).withColumnRenamed("event_type", "ioc"), verdicts, timestomped=every(11), encrypted=errors, downloaded=every(13), notes=every(17), payload=every(19), created_burst=every(23), modified_burst=every(29))


# Processes: every event starts a process; ids repeat, so a parent is the latest one before.

_PROC = """p AS (SELECT event_id AS id, 'h' || user_id % 5 AS host, ts, (event_id * 7 % 97)::VARCHAR AS pid, (event_id * 11 % 97)::VARCHAR AS ppid FROM events),
l AS (SELECT a.id, b.id AS parent_id FROM p a ASOF LEFT JOIN p b ON a.host = b.host AND a.ppid = b.pid AND a.ts > b.ts)"""


def _processes(spark, d):
    e = read(spark, d, "events")
    text = lambda c: c.cast("string")
    tools = F.array(*map(F.lit, ("cmd.exe", "powershell.exe", "winword.exe", "rclone.exe", "notepad.exe", "whoami.exe", "svchost.exe")))
    image = F.concat(F.lit("C:\\Windows\\"), F.get(tools, (F.col("event_id") % 7).cast("int")))
    parent = F.concat(F.lit("C:\\Office\\"), F.get(tools, (F.col("user_id") % 7).cast("int")))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("h"), text(F.col("user_id") % 5)).alias("host"), text(F.col("ts")).alias("ts"), text(F.col("event_id") * 7 % 97).alias("pid"), text(F.col("event_id") * 11 % 97).alias("ppid"),
        F.lit("").alias("guid"), F.lit("").alias("pguid"), image.alias("image"), parent.alias("parent_image"), F.concat(F.lit("run "), "event_type", F.when(F.col("event_id") % 10 == 0, " -enc AAAA").otherwise("")).alias("command"),
    )


@query(f"WITH {_PROC} SELECT id, coalesce(parent_id, -1) AS parent_id FROM l")
def process_links(spark, d):
    return process.link_parents(_processes(spark, d)).select("id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query(f"WITH RECURSIVE {_PROC}, w AS (SELECT id, 0 AS depth, id AS root FROM l WHERE parent_id IS NULL UNION ALL SELECT l.id, w.depth + 1, w.root FROM l JOIN w ON l.parent_id = w.id) SELECT id, CAST(depth AS INTEGER) AS depth, root FROM w")
def process_trees(spark, d):
    return process.depths(process.link_parents(_processes(spark, d)).select("id", "parent_id"))


@query("SELECT c_custkey AS id, CAST(c_custkey AS INTEGER) % 150 AS depth, c_custkey - c_custkey % 150 AS root FROM customer")
def deep_trees(spark, d):
    """Chains of 150 processes."""
    key = F.col("c_custkey")
    edges = read(spark, d, "customer").select(key.alias("id"), F.when(key % 150 != 0, key - 1).alias("parent_id"))
    return process.ancestors(edges).select("id", "depth", "root")


_RULES = [("winword", "cmd", 3), ("cmd", "whoami", 1), ("powershell", "rclone", 3)]


@query(f"""WITH t AS (SELECT ['cmd', 'powershell', 'winword', 'rclone', 'notepad', 'whoami', 'svchost'] AS names), e AS (SELECT event_id, names[1 + event_id % 7] AS child, names[1 + user_id % 7] AS parent FROM events, t),
r AS {values(_RULES, 'parent, child, level')} SELECT e.event_id AS id, CAST(greatest(coalesce(r.level, -1), CASE WHEN event_id % 10 = 0 THEN 3 WHEN e.child = 'rclone' THEN 2 ELSE 0 END) AS INTEGER) AS level FROM e LEFT JOIN r USING (parent, child)""")
def chain_rules_events(spark, d):
    rules = spark.createDataFrame([(k, f"{p}.exe", c, n, "x") for k, (p, c, n) in enumerate(_RULES)], "position int, parent string, child string, level int, reason string")
    return process.assess(_processes(spark, d), rules).select("id", "level")


@query("SELECT event_id AS id, ts, true AS truncated FROM events ORDER BY ts, event_id LIMIT 500")
def process_cap(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), "ts")
    return process.capped(rows, ["ts", "id"], 500)


@query("""SELECT event_id AS id, CASE event_id % 2 WHEN 0 THEN (event_id % 5000)::VARCHAR ELSE '0x' || lower(printf('%x', event_id % 5000)) END AS shown, (event_id % 5000)::VARCHAR AS pid, '77' AS ppid, 'C:\\a\\' || event_type || '.exe' AS image, 'u' || user_id AS "user" FROM events WHERE event_id % 3 = 0""")
def process_selection(spark, d):
    """Audit events of process creation (4688): new process ids are children, in decimal or hexadecimal."""
    e, number = read(spark, d, "events"), F.col("event_id") % 5000
    shown = F.when(F.col("event_id") % 2 == 0, number.cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(number))))
    rows = e.select(
        F.col("event_id").alias("_rowid"), F.when(F.col("event_id") % 3 == 0, 4688).otherwise(4624).alias("EventID"), F.col("ts").alias("datetime"), F.lit("h").alias("Computer"), shown.alias("NewProcessId"), F.lit("0x4d").alias("ProcessId"),
        F.concat(F.lit("C:\\a\\"), "event_type", F.lit(".exe")).alias("NewProcessName"), F.lit("").alias("ParentProcessName"), F.lit("").alias("CommandLine"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("TargetUserName"),
    )
    return process.process_roles(rows, "security").join(rows.select("_rowid", F.col("NewProcessId").alias("shown")), "_rowid").select(F.col("_rowid").alias("id"), "shown", "pid", "ppid", "image", "user")


@query("SELECT 'raw' AS mode, count(*) AS n FROM events UNION ALL SELECT 'hunt', count(*) FROM events WHERE event_id % 4 > 0 UNION ALL SELECT 'triage', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 4 > 0)")
def process_views(spark, d):
    rows = read(spark, d, "events").select((F.col("event_id") % 4).alias("level"), F.col("user_id").alias("host"), F.col("event_type").alias("image"), F.lit("").alias("command"))
    parts = [process.view(rows, m).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("raw", "hunt", "triage")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Elevated' WHEN 2 THEN 'System' ELSE 'other' END AS name FROM events")
def integrity_names(spark, d):
    raw = F.get(F.array(*map(F.lit, ("S-1-16-12288", "%%1937", "S-1-16-16384", "other"))), (F.col("event_id") % 4).cast("int"))
    return read(spark, d, "events").select("event_id", T.integrity_name(raw).alias("name"))


# Lateral movement: users move between a few hosts.

_LOGON = """g AS (SELECT event_id, CAST(CASE user_id % 4 WHEN 0 THEN 4625 WHEN 1 THEN 4672 ELSE 4624 END AS INTEGER) AS eid, ts, CASE WHEN user_id % 9 = 0 THEN '-' ELSE 'H' || user_id % 6 END AS source, 'H' || event_id % 5 AS target, CASE WHEN user_id % 10 = 0 THEN 'SYSTEM' ELSE 'u' || user_id % 7 END AS "user", CAST(2 + event_id % 9 AS INTEGER) AS logon_type FROM events)"""


def _logons(spark, d):
    e, number = read(spark, d, "events"), lambda c: c.cast("string")
    u, k = F.col("user_id"), F.col("event_id")
    return e.select(
        F.when(u % 4 == 0, 4625).when(u % 4 == 1, 4672).otherwise(4624).alias("event_id"), "ts", F.when(u % 9 == 0, F.lit("-")).otherwise(F.concat(F.lit("H"), number(u % 6))).alias("source"),
        F.concat(F.lit("H"), number(k % 5)).alias("target"), F.when(u % 10 == 0, F.lit("SYSTEM")).otherwise(F.concat(F.lit("u"), number(u % 7))).alias("user"), (k % 9 + 2).cast("int").alias("logon_type"),
    )


@query(f"""WITH {_LOGON} SELECT source, target, "user", logon_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT eid::VARCHAR)), ',') AS event_ids, logon_type = 8 AS clear_text FROM g WHERE source <> '-' AND "user" <> 'SYSTEM' AND eid <> 4672 GROUP BY source, target, "user", logon_type""")
def lateral_edges_events(spark, d):
    return lateral.logon_edges(_logons(spark, d))


@query("SELECT string_agg('N' || n_nationkey, '>' ORDER BY n_nationkey) AS path, CAST(count(*) - 1 AS INTEGER) AS hops, false AS cut FROM nation UNION ALL SELECT 'N30>N31', 1, false")
def chain_of_hosts(spark, d):
    """One path through all 25 hosts, and a short one."""
    key = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("N"), c.cast("string"))
    hops = read(spark, d, "nation").where(key < 24).select(name(key).alias("source"), name(key + 1).alias("target"), key.cast("int").alias("first_ts"))
    return lateral.chains(hops.unionByName(spark.createDataFrame([("N30", "N31", 5)], "source string, target string, first_ts int"))).select("path", "hops", "cut")


@query(f"""WITH {_LOGON}, x AS (SELECT * FROM g WHERE source <> '-' AND "user" <> 'SYSTEM' AND eid <> 4672), h AS (SELECT source AS host FROM x UNION SELECT target FROM x)
SELECT (SELECT count(*) FROM x WHERE eid = 4625) AS findings, (SELECT count(*) FROM h) AS hosts, 0::BIGINT AS outliers, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM x)) AS connections, (SELECT count(DISTINCT "user") FROM x) AS users,
(SELECT count(*) FROM (SELECT DISTINCT target FROM x)) AS sessions, 3 AS longest_chain, (SELECT count(*) FROM g WHERE source <> '-' AND "user" <> 'SYSTEM') AS events""")
def lateral_cards(spark, d):
    rows = lateral.relevant(_logons(spark, d))
    kept = rows.where("makes_edge")
    paths = lateral.chains(spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3)], "source string, target string, first_ts int"))
    return lateral.stats_cards(kept, kept.where("event_id = 4625"), kept.select("target").distinct(), paths, rows)


@query(f"SELECT event_id, CASE WHEN regexp_matches(name, '{lateral.REMOTE_TOOLS}') THEN 'rmm' WHEN regexp_matches(name, '{lateral.TUNNELS}') THEN 'tunnel' END AS kind FROM (SELECT event_id, ['C:\\AnyDesk.exe', 'ngrok http 80', 'frp', 'notepad', 'TeamViewer_Service.exe', 'chisel client'][1 + event_id % 6] AS name FROM events)")
def remote_tools(spark, d):
    names = F.array(*map(F.lit, ("C:\\AnyDesk.exe", "ngrok http 80", "frp", "notepad", "TeamViewer_Service.exe", "chisel client")))
    return read(spark, d, "events").select("event_id", lateral.remote_tool(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("kind"))


@query("SELECT event_id, 'DOM' || user_id % 5 AS domain, 'u' || user_id AS \"user\", (event_id % 9)::VARCHAR AS session_id, '10.0.0.' || user_id % 250 AS source FROM events")
def session_payloads(spark, d):
    e, number = read(spark, d, "events"), lambda c: c.cast("string")
    one = F.concat(F.lit("User: DOM"), number(F.col("user_id") % 5), F.lit("\\u"), number(F.col("user_id")))
    out = T.session_payload(one, F.concat(F.lit("Session ID: "), number(F.col("event_id") % 9)), F.concat(F.lit("Source Network Address: 10.0.0."), number(F.col("user_id") % 250)))
    return e.select("event_id", out.alias("p")).select("event_id", "p.*")


@query("SELECT event_id, 'WS' || user_id AS workstation, '10.0.0.' || user_id % 250 AS ip FROM events")
def remote_hosts(spark, d):
    number = lambda c: c.cast("string")
    raw = F.concat(F.lit("WS"), number(F.col("user_id")), F.lit(" (10.0.0."), number(F.col("user_id") % 250), F.lit(")"))
    return read(spark, d, "events").select("event_id", T.remote_host(raw).alias("p")).select("event_id", "p.*")


# Persistence.


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Services' WHEN event_id % 3 = 1 THEN 'Scheduled Tasks' ELSE 'Own' END AS category, CAST(CASE WHEN event_id % 3 = 0 THEN 7 WHEN event_id % 3 = 1 THEN 5 ELSE 9 END AS INTEGER) AS risk FROM events WHERE event_id % 3 < 2 OR event_type = 'error'")
def custom_event_rules(spark, d):
    """Built-in rules with one switched off, and an analyst's own with a payload pattern."""
    own = [{"category": "Own", "name": "Odd event", "event_ids": [9999], "channels": ["App"], "severity": "Critical", "payload": r"error"}]
    k = F.col("event_id")
    rows = read(spark, d, "events").select(k.alias("id"), F.when(k % 3 == 0, 7045).when(k % 3 == 1, 4698).otherwise(9999).alias("eid"), F.when(k % 3 == 0, "System").when(k % 3 == 1, "Security").otherwise("Application").alias("channel"), F.lit("n").alias("name"), F.when(k % 3 == 2, F.col("event_type")).otherwise(F.lit("C:\\Users\\a\\x.bin")).alias("command"))
    twice = rows.withColumnRenamed("eid", "event_id").unionByName(rows.select("id", F.lit(106).alias("event_id"), F.lit("TaskScheduler").alias("channel"), "name", "command"))
    rules = persistence.with_custom_events(persistence.event_rules(spark), own, off=["Task registered"])
    return persistence.custom_payload(persistence.event_findings(twice, rules), own).select("id", "category", "risk")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'Winlogon' ELSE 'Own key' END AS location, CAST(CASE event_id % 3 WHEN 0 THEN 6 ELSE 3 END AS INTEGER) AS risk FROM events WHERE event_id % 3 < 2")
def custom_registry_rules(spark, d):
    own = [{"name": "Own key", "key": r"\\Vendor\\", "value_name": "^auto", "severity": "Medium"}]
    k = F.col("event_id")
    key = F.when(k % 3 == 0, F.lit("HKLM\\x\\Winlogon")).when(k % 3 == 1, F.lit("HKLM\\Vendor\\x")).otherwise(F.lit("HKLM\\SOFTWARE\\CurrentVersion\\Run"))
    rows = read(spark, d, "events").select(k.alias("id"), key.alias("key"), F.lit("AutoStart").alias("value_name"), F.lit("a").alias("value_data"))
    return persistence.registry_findings(rows, own, off=["Run / RunOnce"]).select("id", "location", "risk")


_MODES = [("EventId,Channel,Provider,Computer", "events"), ("HivePath,KeyPath,ValueName,ValueData", "registry"), ("a,b", "events")]


@query(f"SELECT event_id, headers, mode FROM {cases_sql(_MODES, 'headers, mode')}")
def persistence_mode(spark, d):
    """A line of headers for each event, and whether it is one of registry values or of events."""
    mode = F.pandas_udf(lambda texts: texts.map(lambda h: persistence.input_mode(h.split(","))), "string")
    return cases(spark, d, _MODES, "headers string, want string").select("event_id", "headers", mode("headers").alias("mode"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'svc ' || o_orderkey ELSE 'run' || o_custkey % 10 || '.exe -a ' || o_custkey % 10 END AS \"binary\" FROM orders")
def persistence_links(spark, d):
    """Tasks get the command of their definition, services their image path."""
    number = lambda c: c.cast("string")
    o, key, task = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 10
    found = o.select(key.alias("id"), F.when(key % 2 == 0, 7045).otherwise(4698).alias("event_id"), F.concat(F.lit("t"), number(task)).alias("name"), F.concat(F.lit("svc "), number(key)).alias("command"))
    each = spark.range(10).select(F.concat(F.lit("t"), number(F.col("id"))).alias("name"), F.concat(F.lit("<Task><Exec><Command>run"), number(F.col("id")), F.lit(".exe</Command><Arguments>-a "), number(F.col("id")), F.lit("</Arguments></Exec></Task>")).alias("xml"))
    return persistence.correlate(found, each).select("id", "binary")


@query("SELECT r_name AS filter_name, n_name AS consumer_name, 'select ' || r_regionkey AS query, 'run ' || n_nationkey AS command FROM nation JOIN region ON n_regionkey = r_regionkey")
def wmi_links(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    bindings = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("filter_name"), F.col("n_name").alias("consumer_name"))
    filters = r.select(F.col("r_name").alias("filter_name"), F.concat(F.lit("select "), F.col("r_regionkey").cast("string")).alias("query"))
    return persistence.link_wmi(filters, n.select(F.col("n_name").alias("consumer_name"), F.concat(F.lit("run "), F.col("n_nationkey").cast("string")).alias("command")), bindings)


@query("""WITH a AS (SELECT 'a' || o_custkey AS account, o_orderdate AS ts, CASE o_orderkey % 3 WHEN 0 THEN 4720 ELSE 4728 END AS eid FROM orders), m AS (SELECT account, min(ts) AS created FROM a WHERE eid = 4720 GROUP BY 1)
SELECT m.account, created, min(ts) AS added, count(*) AS groups FROM m JOIN a ON a.account = m.account AND eid = 4728 AND ts >= created AND epoch(ts) - epoch(created) <= 8640000 GROUP BY 1, 2""")
def account_chains(spark, d):
    o = read(spark, d, "orders")
    rows = o.select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("account"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 3 == 0, 4720).otherwise(4728).alias("event_id"))
    return persistence.account_chains(rows, 8_640_000)


# Indicators.


@query("SELECT min(b) AS ioc, 'Other' AS category FROM (SELECT p_brand AS b FROM part UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT '# comment' UNION ALL SELECT ' ') WHERE b NOT LIKE '#%' AND trim(b) <> '' GROUP BY lower(b)")
def ioc_dedup(spark, d):
    brands = read(spark, d, "part").select(F.col("p_brand").alias("ioc"))
    extra = spark.createDataFrame([("# comment",), (" ",)], "ioc string")
    return ioc.prepare(brands.unionByName(brands.select(F.upper("ioc").alias("ioc"))).unionByName(extra))


_PATTERNS = (r"brand#1\d", r"large\s+\w+", "economy", r"^no match$")


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT p_partkey AS row, '{p}' AS ioc FROM part WHERE regexp_matches(p_brand || chr(1) || p_type, '(?i){p}')" for p in _PATTERNS) + ") SELECT row, array_to_string(list_sort(list(ioc)), '|') AS iocs FROM h GROUP BY row")
def ioc_patterns(spark, d):
    """Indicators that are regular expressions, and the indicators of each row."""
    hits = ioc.match_patterns(read(spark, d, "part"), _PATTERNS, ["p_brand", "p_type"], "p_partkey", batch=2)
    return ioc.row_map(hits).select("row", F.array_join("iocs", "|").alias("iocs"))


@query("SELECT p_partkey AS row, array_to_string(list_sort(list(DISTINCT b)), '|') AS iocs FROM part JOIN (SELECT DISTINCT p_brand AS b FROM part UNION SELECT 'BRAND#1') ON contains(lower(p_name || chr(1) || p_brand), lower(b)) GROUP BY 1")
def ioc_row_map(spark, d):
    parts = read(spark, d, "part")
    iocs = parts.select(F.col("p_brand").alias("ioc")).distinct().unionByName(spark.createDataFrame([("BRAND#1",)], "ioc string"))
    return ioc.row_map(ioc.match(parts, iocs, ["p_name", "p_brand"], "p_partkey")).select("row", F.array_join("iocs", "|").alias("iocs"))


# File system.

_BASE = 133_498_026_000_000_000
_TIMES = f"""f AS (SELECT o_orderkey AS entry, CASE o_orderkey % 3 WHEN 0 THEN 'a.exe' ELSE 'b.txt' END AS name, CASE o_orderkey % 7 WHEN 0 THEN '.\\Windows\\WinSxS\\x' ELSE '.\\Users' END AS path, {_BASE} + o_orderkey * 10000000 AS t, o_custkey AS c FROM orders),
s AS (SELECT *, t + 5 - CASE c % 4 WHEN 0 THEN 36000000001 ELSE 0 END AS sc, t + 7 AS sm, t + 9 - CASE c % 5 WHEN 0 THEN 1728000000001 ELSE 0 END AS sx, t + CASE c % 6 WHEN 0 THEN 0 ELSE 3 END AS sa FROM f),
r AS (SELECT *, sc < t OR sm < t OR sx < t OR sa < t AS behind, sc % 10000000 = 0 OR sm % 10000000 = 0 OR sx % 10000000 = 0 OR sa % 10000000 = 0 AS zero, sc > sm AS copied, greatest(0, t - sc, t - sm, t - sx, t - sa) / 1e7 AS delta FROM s),
k AS (SELECT *, CASE WHEN delta > 86400 THEN 3 WHEN delta > 3600 THEN 2 ELSE 1 END + CASE WHEN name = 'a.exe' THEN 1 ELSE 0 END AS step, starts_with(path, '.\\Windows') AS safe FROM r WHERE behind OR zero)"""


def _stamped(spark, d):
    o = read(spark, d, "orders")
    t, c = F.col("o_orderkey") * 10_000_000 + _BASE, F.col("o_custkey")
    less = lambda n, ticks: F.when(c % n == 0, F.lit(ticks).cast("long")).otherwise(F.lit(0).cast("long"))
    si = {"created": t + 5 - less(4, 36_000_000_001), "modified": t + 7, "changed": t + 9 - less(5, 1_728_000_000_001), "accessed": t + F.when(c % 6 == 0, 0).otherwise(3)}
    names = [F.when(F.col("o_orderkey") % 3 == 0, "a.exe").otherwise("b.txt").alias("name"), F.when(F.col("o_orderkey") % 7 == 0, ".\\Windows\\WinSxS\\x").otherwise(".\\Users").alias("path")]
    return o.select(F.col("o_orderkey").alias("entry"), *names, *[v.alias(f"si_{k}") for k, v in si.items()], *[t.alias(f"fn_{k}") for k in si])


@query(f"WITH {_TIMES} SELECT entry, behind AS si_before_fn, zero AS zero_subsecond, copied, round(delta, 6) AS delta_seconds, CASE step WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, safe AS suppressed FROM k")
def timestomping_files(spark, d):
    found = ntfs.timestomping(_stamped(spark, d))
    return found.select("entry", "si_before_fn", "zero_subsecond", "copied", F.round("delta_seconds", 6).alias("delta_seconds"), "severity", "suppressed")


@query(f"WITH {_TIMES} SELECT count(*) FILTER (WHERE behind) AS raw, count(*) FILTER (WHERE safe) AS suppressed, count(*) FILTER (WHERE copied AND NOT safe) AS copied, count(*) FILTER (WHERE NOT copied AND NOT safe) AS confirmed FROM k")
def timestomping_summary(spark, d):
    return ntfs.timestomp_summary(ntfs.timestomping(_stamped(spark, d)))


@query("""WITH g AS (SELECT lower(p_type) AS t FROM part), x AS (SELECT '.' || regexp_extract(t, '([^ ]*)$', 1) AS extension, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT extension, unnest(string_split(extension, '')) AS ch, length(extension) AS l FROM x), e AS (SELECT extension, ch, l, count(*) AS k FROM c GROUP BY ALL)
SELECT x.extension, x.n, round(sum(-(k::DOUBLE / l) * log2(k::DOUBLE / l)), 6) AS entropy FROM x JOIN e USING (extension) GROUP BY 1, 2""")
def extension_entropy(spark, d):
    files = read(spark, d, "part").select(F.concat(F.lit("f."), F.regexp_extract("p_type", "([^ ]*)$", 1)).alias("name"))
    return ntfs.extension_scan(files)


@query("SELECT event_type AS path, count(*) AS files FROM events WHERE user_id % 3 = 0 GROUP BY 1 ORDER BY files DESC, path LIMIT 3")
def ransomware_folders(spark, d):
    files = read(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, "x.LOCKED").otherwise("x.txt").alias("name"), F.col("event_type").alias("path"))
    return ntfs.ransomware_folders(files, ".locked", 3)


@query("""WITH s AS (SELECT min(ts) - INTERVAL 5 MINUTE AS lo, max(ts) + INTERVAL 5 MINUTE AS hi FROM events WHERE event_type = 'error' AND event_id % 400 < 40)
SELECT event_id AS usn, CASE event_id % 4 WHEN 0 THEN 'RenameNewName' WHEN 1 THEN 'FileDelete|Close' ELSE 'DataOverwrite' END AS reasons FROM events, s WHERE event_id % 4 < 3 AND ts BETWEEN lo AND hi""")
def ransomware_journal(spark, d):
    """Journal records around the encryption that the rollup found."""
    e, k = read(spark, d, "events"), F.col("event_id")
    files = e.select(F.when((F.col("event_type") == "error") & (k % 400 < 40), "x.k").otherwise("x.t").alias("name"), k.alias("size"), F.col("ts").cast("timestamp").alias("ts"))
    reasons = F.when(k % 4 == 0, "RenameNewName").when(k % 4 == 1, "FileDelete|Close").when(k % 4 == 2, "DataOverwrite").otherwise("Close")
    return ntfs.ransomware_journal(e.select(k.alias("usn"), F.col("ts").cast("timestamp").alias("ts"), reasons.alias("reasons")), ntfs.ransomware(files, ".k", "note")).select("usn", "reasons")


@query("SELECT event_id AS entry, CASE event_id % 5 WHEN 0 THEN 'zone' WHEN 1 THEN 'executable' WHEN 2 THEN 'executable' WHEN 3 THEN 'known' ELSE 'suspicious' END AS kind FROM events")
def stream_kinds(spark, d):
    k = F.col("event_id") % 5
    stream = F.when(k == 0, "Zone.Identifier").when(k == 1, "x.exe").when(k == 3, "favicon").otherwise("hidden")
    return ntfs.stream_findings(read(spark, d, "events").select(F.col("event_id").alias("entry"), stream.alias("stream"), F.when(k == 2, "MZ\u0090").otherwise("text").alias("content"))).select("entry", "kind")


_JOURNAL_PATHS = """SELECT event_id AS usn, CASE WHEN event_id % 10 = 9 THEN '.\\table' WHEN event_id % 10 = 8 THEN '.\\[ORPHAN]' WHEN event_id % 10 = 0 THEN '.' ELSE '.\\d' || event_id // 10 END AS parent_path FROM events"""


def _journal(spark, d):
    k = F.col("event_id")
    tens = F.floor(k / 10)
    folder = (tens + 1000).cast("long")
    parent = F.when(k % 10 == 0, F.lit(5)).when(k % 10 == 9, F.lit(900)).when(k % 10 == 8, F.lit(901)).otherwise(folder)
    name = F.when(k % 10 == 0, F.concat(F.lit("d"), tens.cast("string"))).otherwise(F.lit("f.txt"))
    return read(spark, d, "events").select(k.alias("usn"), F.when(k % 10 == 0, folder).otherwise(k + 10_000_000).alias("entry"), F.lit(1).alias("seq"), parent.cast("long").alias("parent_entry"), F.lit(1).alias("parent_seq"), name.alias("name"), (k % 10 == 0).alias("is_dir"))


@query(_JOURNAL_PATHS)
def journal_paths(spark, d):
    """Every tenth record creates a folder that the next seven name; the file table knows one folder more."""
    return ntfs.journal_paths(_journal(spark, d), spark.createDataFrame([(900, 5, "table")], "entry long, parent long, name string")).select("usn", "parent_path")


@query(_JOURNAL_PATHS)
def journal_paths_refreshed(spark, d):
    """The same where the file table comes later: once with a folder too many and one misnamed, then as it is."""
    table = lambda *rows: spark.createDataFrame(list(rows), "entry long, parent long, name string")
    first, then = table((900, 5, "old"), (901, 5, "gone")), table((900, 5, "table"))
    saved = ntfs.refresh_paths(ntfs.saved_paths(_journal(spark, d)), ntfs.path_changes(None, first))
    return ntfs.refresh_paths(saved, ntfs.path_changes(first, then)).select("usn", "parent_path")


@query("SELECT c_custkey + 100 AS entry, '.' || (SELECT string_agg('\\d' || x, '' ORDER BY x) FROM range(c_custkey - c_custkey % 100, c_custkey + 1) r(x)) AS path FROM customer UNION ALL SELECT 5, '.'")
def deep_paths(spark, d):
    """Folders a hundred levels deep."""
    key = F.col("c_custkey")
    rows = read(spark, d, "customer").select((key + 100).alias("entry"), F.when(key % 100 == 0, F.lit(5)).otherwise(key + 99).cast("long").alias("parent"), F.concat(F.lit("d"), key.cast("string")).alias("name"))
    return ntfs.parent_paths(rows)


# Scalar functions and small detectors, each on a value derived from every event.


def _choice(of, *texts):
    return F.get(F.array(*map(F.lit, texts)), (of % len(texts)).cast("int"))


def _sql_choice(of: str, *texts: str) -> str:
    shown = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"([{shown}])[1 + {of} % {len(texts)}]"


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 IN (1, 3) THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS ts FROM events")
def timestamp_spellings(spark, d):
    """Times written in six ways and read back."""
    e = read(spark, d, "events")
    ways = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy", "MM/dd/yyyy h:mm:ss a", "MMMM d, yyyy"]
    each = [F.date_format("ts", w) for w in ways] + [F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit("not a time")]
    raw = F.get(F.array(*each), (F.col("event_id") % 6).cast("int"))
    from ..functions.timestamps import normalize_timestamp

    return e.select("event_id", normalize_timestamp(raw).cast("timestamp_ntz").alias("ts"))


_BITS = sorted(T.USN_REASONS.items())


@query("SELECT event_id, coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN event_id * 2654435761 % 4294967296 & {b} <> 0 THEN '{n}' END" for b, n in _BITS) + "), ''), (event_id * 2654435761 % 4294967296)::VARCHAR) AS names FROM events")
def reason_flags(spark, d):
    bits = F.col("event_id") * F.lit(2_654_435_761).cast("long") % F.lit(4_294_967_296).cast("long")
    return read(spark, d, "events").select("event_id", T.flag_names(bits, T.USN_REASONS, bits.cast("string")).alias("names"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '.t' || user_id WHEN 3 THEN '.gz' ELSE '' END AS ext, (event_id % 70000)::VARCHAR AS pid, CASE WHEN event_id < 60 THEN event_id || 'm' WHEN event_id < 1440 THEN (event_id // 60) || 'h ' || (event_id % 60) || 'm' ELSE (event_id // 1440) || 'd ' || (event_id % 1440 // 60) || 'h' END AS span FROM events")
def small_functions_events(spark, d):
    k = F.col("event_id")
    name = F.get(F.array(F.concat(F.lit("f.t"), F.col("user_id").cast("string")), F.lit(".hidden"), F.lit("ends."), F.lit("a.tar.gz")), (k % 4).cast("int"))
    return read(spark, d, "events").select("event_id", T.extension(name).alias("ext"), T.hex_to_decimal(F.concat(F.lit("0x"), F.hex(k % 70000))).alias("pid"), T.duration_text(k).alias("span"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^(?i)[a-z]+://', ''), '[/?#].*$', ''), '\\.$', '') AS ioc FROM pages WHERE regexp_matches(url, '^(?i)(https?|ftp)://') AND NOT regexp_matches(url, '[ \\[\\]()]')")
def defanged_urls(spark, d):
    """Addresses that are defanged and come back without scheme, path and defanging."""
    url = F.col("url")
    masked = F.replace(F.replace(F.regexp_replace(url, "^(?i)http", "hxxp"), F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))
    return read(spark, d, "pages").where(url.rlike("^(?i)(https?|ftp)://") & ~url.rlike(r"[ \[\]()]")).select("page_id", T.defang(masked).alias("ioc"))


@query("SELECT event_id, (['MD5', 'IPv4:Port', 'Email', 'Domain', 'Filename', 'Registry', 'Path', 'Other'])[1 + event_id % 8] AS kind, CASE WHEN event_id % 8 = 1 THEN '10.' || user_id % 250 || '.0.1' ELSE NULL END AS bare FROM events")
def indicator_kinds(spark, d):
    n, k = F.col("user_id").cast("string"), F.col("event_id") % 8
    each = F.array(F.md5(n), F.concat(F.lit("10."), (F.col("user_id") % 250).cast("string"), F.lit(".0.1:443")), F.concat(F.lit("u"), n, F.lit("@x.org")), F.concat(F.lit("h"), n, F.lit(".example.com")), F.concat(F.lit("f"), n, F.lit(".exe")), F.concat(F.lit("HKLM\\k"), n), F.concat(F.lit("C:\\d\\"), n), F.lit("???"))
    value = F.get(each, k.cast("int"))
    return read(spark, d, "events").select("event_id", T.classify_ioc(value).alias("kind"), F.when(k == 1, T.verdict_key(value)).alias("bare"))


@query("SELECT event_id, regexp_matches(ip, '^(10\\.|127\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS private FROM (SELECT event_id, (['10.1', '172.' || user_id % 64, '192.168', '8.8', '127.0'])[1 + event_id % 5] || '.0.' || user_id % 250 AS ip FROM events)")
def private_addresses(spark, d):
    number = lambda c: c.cast("string")
    first = F.get(F.array(F.lit("10.1"), F.concat(F.lit("172."), number(F.col("user_id") % 64)), F.lit("192.168"), F.lit("8.8"), F.lit("127.0")), (F.col("event_id") % 5).cast("int"))
    return read(spark, d, "events").select("event_id", T.is_private_ip(F.concat(first, F.lit(".0."), number(F.col("user_id") % 250), F.lit(":80"))).alias("private"))


@query("""WITH v AS (SELECT lower(p_brand) AS key, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1), j AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END AS ioc FROM part)
SELECT p_partkey || ':' || j.ioc AS ioc, CASE WHEN key IS NULL THEN 'not_found' WHEN low % 2 = 1 THEN 'malicious' WHEN high % 2 = 1 THEN 'suspicious' ELSE 'clean' END AS verdict, CASE WHEN key IS NULL THEN 0.0::DOUBLE ELSE (low % 2 + high % 2)::DOUBLE / 70 END AS score FROM j LEFT JOIN v ON key = lower(j.ioc)""")
def verdict_joins(spark, d):
    parts = read(spark, d, "part")
    grouped = parts.groupBy(F.lower("p_brand").alias("key")).agg((F.min("p_size") % 2).alias("malicious"), (F.max("p_size") % 2).alias("suspicious"), F.lit(70).alias("total"))
    each = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_brand")).alias("ioc"))
    found = ioc.enrich(each.select("ioc").distinct(), grouped)
    return each.join(found, "ioc").select(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "ioc").alias("ioc"), "verdict", "score")


@query("""WITH r AS (SELECT event_id AS usn, """ + _sql_choice("event_id", "RenameNewName", "FileDelete|Close", "FileCreate", "DataExtend", "SecurityChange", "Close") + """ AS reasons, """ + _sql_choice("user_id", ".\\a\\x.zip", ".\\Temp\\y.exe", ".\\Startup\\z.txt", ".\\b\\w") + """ AS path FROM events),
c AS (SELECT usn, 'renames' AS category FROM r WHERE contains(reasons, 'Rename') UNION ALL SELECT usn, 'deletions' FROM r WHERE contains(reasons, 'FileDelete') UNION ALL SELECT usn, 'creations' FROM r WHERE contains(reasons, 'FileCreate')
UNION ALL SELECT usn, 'exfiltration' FROM r WHERE reasons IN ('FileCreate', 'DataExtend') AND path LIKE '%.zip' UNION ALL SELECT usn, 'execution' FROM r WHERE reasons IN ('FileCreate', 'DataExtend') AND path LIKE '%.exe' UNION ALL SELECT usn, 'persistence' FROM r WHERE contains(path, 'Startup')
UNION ALL SELECT usn, 'suspicious paths' FROM r WHERE contains(path, 'Temp') UNION ALL SELECT usn, 'security changes' FROM r WHERE reasons = 'SecurityChange' UNION ALL SELECT usn, 'close patterns' FROM r WHERE ends_with(reasons, 'Close')) SELECT * FROM c""")
def journal_categories_events(spark, d):
    reasons = _choice(F.col("event_id"), "RenameNewName", "FileDelete|Close", "FileCreate", "DataExtend", "SecurityChange", "Close")
    path = _choice(F.col("user_id"), ".\\a\\x.zip", ".\\Temp\\y.exe", ".\\Startup\\z.txt", ".\\b\\w")
    return ntfs.journal_categories(read(spark, d, "events").select(F.col("event_id").alias("usn"), reasons.alias("reasons"), path.alias("path"))).select("usn", "category")


@query("SELECT user_id AS entry, CAST(1 AS INTEGER) AS seq, string_agg('f' || user_id || ': ' || event_type, ' > ' ORDER BY event_id) AS story FROM events GROUP BY 1")
def file_stories(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("usn"), F.col("user_id").alias("entry"), F.lit(1).alias("seq"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("reasons"))
    return ntfs.file_chains(rows)


@query("SELECT event_id AS entry, CAST(event_id % 5 AS INTEGER) AS zone, 'http://r' || user_id || '/' AS referrer, 'http://h' || user_id || '/' || event_type AS host_url FROM events WHERE event_id % 2 = 0")
def zone_records(spark, d):
    n = F.col("user_id").cast("string")
    text = F.concat(F.lit("[ZoneTransfer]\r\nZoneId="), (F.col("event_id") % 5).cast("string"), F.lit("\r\nReferrerUrl=http://r"), n, F.lit("/\r\nHostUrl=http://h"), n, F.lit("/"), "event_type", F.lit("\r\n"))
    return ntfs.streams(read(spark, d, "events").select(F.col("event_id").alias("entry"), F.when(F.col("event_id") % 2 == 0, text).otherwise("").alias("zone_contents")))


_HOST_NAMES = ("DESKTOP-AB12CD3", "WIN-12345678", "kali", "myvps01", "DC01", "winvm7", "SRV-FILES")


@query(f"SELECT event_id, CASE WHEN regexp_matches(host, '{lateral.OUTLIER_HOST}') OR regexp_matches(host, '[^\\x00-\\x7F]') THEN 1 WHEN regexp_matches(host, '{lateral.SUSPICIOUS_HOST}') THEN 2 ELSE 0 END AS tier FROM (SELECT event_id, {_sql_choice('event_id', *_HOST_NAMES)} || CASE WHEN user_id % 20 = 0 THEN 'ö' ELSE '' END AS host FROM events)")
def host_tiers_events(spark, d):
    host = F.concat(_choice(F.col("event_id"), *_HOST_NAMES), F.when(F.col("user_id") % 20 == 0, "ö").otherwise(""))
    return read(spark, d, "events").select("event_id", lateral.host_tier(host).alias("tier"))


_COMMANDS = ("cmd.exe /Q /c cd 1> \\\\127.0.0.1\\ADMIN$\\__1 2>&1", "x __output y", "mmc.exe -Embedding", "\\\\.\\pipe\\RemCom_communicat", "C:\\Windows\\Temp\\ab12.tmp 2>&1", "notepad")


@query(f"SELECT event_id, {_sql_choice('event_id', 'wmiexec', 'smbexec', 'dcomexec', 'psexec', 'atexec', '-')} AS variant FROM events")
def remote_execution_events(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(lateral.remote_execution(_choice(F.col("event_id"), *_COMMANDS)), F.lit("-")).alias("variant"))


@query("SELECT 'T' || s.k AS target, 'u' AS \"user\", CAST(1 AS BIGINT) AS session, CAST(4 AS BIGINT) AS n, 'ENDED' AS status, true AS admin, false AS reconnect FROM (SELECT DISTINCT user_id AS k FROM events) s")
def rdp_sessions_events(spark, d):
    """A remote session for each user: authentication, logon, privileges and logoff."""
    users = read(spark, d, "events").select("user_id").distinct()
    steps = F.array(*[F.struct(F.lit(e).alias("event_id"), F.lit(s).alias("s")) for e, s in ((1149, 0), (21, 5), (4672, 8), (23, 900))])
    rows = users.select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("target"), F.explode(steps).alias("x"))
    rows = rows.select(F.col("x.event_id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("x.s")).alias("ts"), F.lit("A").alias("source"), "target", F.lit("u").alias("user"))
    return lateral.rdp_sessions(rows, None).select("target", "user", "session", "n", "status", "admin", "reconnect")


@query("SELECT event_id, event_type || ' by ' || user_id AS message FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, '' FROM events WHERE event_type = 'view'")
def event_messages(spark, d):
    """Messages from a table of templates by provider and event id; events without a template have none."""
    from ..sources.artifacts import with_messages

    e = read(spark, d, "events")
    data = F.create_map(F.lit("User"), F.col("user_id").cast("string"), F.lit("Kind"), F.col("event_type"))
    rows = e.select("event_id", F.lit("P").alias("Provider"), F.when(F.col("event_type") == "view", "2").otherwise("1").alias("EventID"), data.alias("data"))
    return with_messages(rows, spark.createDataFrame([("P", "1", "%2 by %1"), ("Q", "2", "no")], "Provider string, EventID string, template string")).select("event_id", F.col("Message").alias("message"))
