"""Queries of functions and rules: cases written here, one for each event of the driver's table or all of them for each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timestamps as S
from ..operators.chain_rules import rules as chain_pairs
from ..operators import ioc, lateral, ntfs, persistence, process
from .registry import query, read


def values(rows: list[tuple], names: str) -> str:
    """The rows as a SQL table expression; `names` are its column names."""
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") t({names}))"


def cases_sql(rows: list[tuple], names: str) -> str:
    """(event_id, ...): every event with one of the rows, in turn."""
    numbered = [(k, *r) for k, r in enumerate(rows)]
    return f"(SELECT e.event_id, v.* EXCLUDE (turn) FROM events e JOIN {values(numbered, 'turn, ' + names)} v ON e.event_id % {len(rows)} = v.turn)"


def cases(spark, d, rows: list[tuple], schema: str):
    """The same rows for Spark."""
    numbered = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "turn int, " + schema)
    turns = read(spark, d, "events").select(F.col("event_id").alias("event_id"), (F.col("event_id") % len(rows)).cast("int").alias("turn"))
    return turns.join(F.broadcast(numbered), "turn").drop("turn")  # a few rows


def copies_sql(rows: list[tuple], names: str) -> str:
    """(g, ...): all of the rows for every user of the events."""
    return f"(SELECT u.g, v.* FROM (SELECT DISTINCT user_id AS g FROM events) u, {values(rows, names)} v)"


def copies(spark, d, rows: list[tuple], schema: str):
    """The same rows for Spark."""
    types = spark.createDataFrame([], schema).schema
    each = F.array(*[F.struct(*[F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(r, types, strict=True)]) for r in rows])
    return read(spark, d, "events").select(F.col("user_id").alias("g")).distinct().select("g", F.explode(each).alias("x")).select("g", "x.*")


def _of(name: str):
    """A name that is one user's own."""
    return F.concat(F.col(name), F.lit("-"), F.col("g").cast("string"))


# Scalar functions.

_TIMES = [
    (1, "2024-01-15T14:30:00Z", "2024-01-15 14:30:00"), (2, "2024-01-15 14:30:00", "2024-01-15 14:30:00"), (3, "1/15/2024", "2024-01-15 00:00:00"), (4, "01/15/2024 2:30:00 PM", "2024-01-15 14:30:00"), (5, "Feb 5th 2026", "2026-02-05 00:00:00"), (6, "February 5, 2026", "2026-02-05 00:00:00"), (7, "5 Feb 2026", "2026-02-05 00:00:00"),
    (8, "1705329000", "2024-01-15 14:30:00"), (9, "1705329000000", "2024-01-15 14:30:00"), (10, "45566", "2024-10-01 00:00:00"), (11, "not a time", None), (12, "", None), (13, "99999", None), (14, "2024-01-15T14:30:00+02:00", "2024-01-15 12:30:00"),
]


@query(f"SELECT event_id, id, CAST(want AS TIMESTAMP) AS ts, strftime(CAST(want AS TIMESTAMP), '%Y-%m-%d') AS day, strftime(CAST(want AS TIMESTAMP), '%Y-%m-%d %H:%M') AS minute FROM {cases_sql(_TIMES, 'id, raw, want')}")
def ts_normalize(spark, d):
    x = F.col("raw")
    return cases(spark, d, _TIMES, "id int, raw string, want string").select("event_id", "id", S.normalize_timestamp(x).alias("ts"), S.extract_date(x).alias("day"), S.extract_minute(x).alias("minute"))


_FLAGS = [(1, 0x80000101, "DataOverwrite|FileCreate|Close"), (2, 0, "0"), (3, 0x3000, "RenameOldName|RenameNewName"), (4, 0x200, "FileDelete")]


@query(f"SELECT event_id, id, want AS names FROM {cases_sql(_FLAGS, 'id, bits, want')}")
def flag_decode(spark, d):
    bits = F.col("bits")
    return cases(spark, d, _FLAGS, "id int, bits long, want string").select("event_id", "id", T.flag_names(bits, T.USN_REASONS, bits.cast("string")).alias("names"))


_DEFANG = [(1, "hxxps://evil[.]com/a?b=1#c", "evil.com"), (2, "1.2.3[.]4", "1.2.3.4"), (3, "user[@]bad[dot]org", "user@bad.org"), (4, "http[://]x(.)net.", "x.net"), (5, "1.2.3.4[:]443", "1.2.3.4:443"), (6, "C:\\Temp\\a.exe", "C:\\Temp\\a.exe")]


@query(f"SELECT event_id, id, want AS ioc FROM {cases_sql(_DEFANG, 'id, raw, want')}")
def defang(spark, d):
    return cases(spark, d, _DEFANG, "id int, raw string, want string").select("event_id", "id", T.defang(F.col("raw")).alias("ioc"))


_KINDS = [
    ("d41d8cd98f00b204e9800998ecf8427e", "MD5"), ("da39a3ee5e6b4b0d3255bfef95601890afd80709", "SHA1"), ("a" * 64, "SHA256"), ("1.2.3.4:80", "IPv4:Port"), ("1.2.3.0/24", "IPv4"), ("[::1]:443", "IPv6:Port"), ("fe80::1", "IPv6"), ("a@b.org", "Email"), ("evil.com", "Domain"), ("bad.exe", "Filename"), ("HKLM\\Software\\X", "Registry"), ("C:\\a\\b", "Path"), ("???", "Other"),
]


@query(f"SELECT event_id, value, kind FROM {cases_sql(_KINDS, 'value, kind')}")
def ioc_classify(spark, d):
    return cases(spark, d, _KINDS, "value string, kind string").select("event_id", "value", T.classify_ioc(F.col("value")).alias("kind"))


_MISC = [(1, ".bashrc", "", "0x1a2c", "6700", 45, "45m"), (2, "a.", "", "12", "12", 200, "3h 20m"), (3, "a.tar.gz", ".gz", "0xFF", "255", 3180, "2d 5h"), (4, "x", "", "", "", 0, "0m")]


@query(f"SELECT event_id, id, ext, pid, span FROM {cases_sql(_MISC, 'id, name, ext, raw, pid, minutes, span')}")
def small_functions(spark, d):
    rows = cases(spark, d, _MISC, "id int, name string, ext string, raw string, pid string, minutes int, span string")
    return rows.select("event_id", "id", T.extension(F.col("name")).alias("ext"), T.hex_to_decimal(F.col("raw")).alias("pid"), T.duration_text(F.col("minutes")).alias("span"))


_TICKS = [(1, 0, "", False), (2, 116444735999999999, "", False), (3, 133498026000000000, "2024-01-15 14:30:00.0000000", True), (4, 133498026001234567, "2024-01-15 14:30:00.1234567", False)]


@query(f"SELECT event_id, id, want AS text, zero FROM {cases_sql(_TICKS, 'id, ticks, want, zero')}")
def filetime_text(spark, d):
    x = F.col("ticks")
    return cases(spark, d, _TICKS, "id int, ticks long, want string, zero boolean").select("event_id", "id", S.filetime_string(x).alias("text"), S.zero_subsecond(x).alias("zero"))


_IPS = [("10.1.2.3", True), ("172.20.0.1:80", True), ("172.32.0.1", False), ("::1", True), ("[::1]:443", True), ("8.8.8.8", False), ("fe80::1", False)]


@query(f"SELECT event_id, ip, private FROM {cases_sql(_IPS, 'ip, private')}")
def private_ip(spark, d):
    return cases(spark, d, _IPS, "ip string, private boolean").select("event_id", "ip", T.is_private_ip(F.col("ip")).alias("private"))


@query("""WITH c AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_type) + 1), lambda i: substring(p_type, i, 1))) AS ch, length(p_type) AS n FROM part), g AS (SELECT p_partkey, ch, n, count(*) AS k FROM c GROUP BY ALL)
SELECT p_partkey, round(sum(-(k::DOUBLE / n) * log2(k::DOUBLE / n)), 6) AS bits FROM g GROUP BY 1""")
def text_entropy(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(T.entropy(F.col("p_type")), 6).alias("bits"))


# Processes.

_PROCESSES = [
    (1, "h1", "2024-01-01 00:00:01", "100", "4", "{a}", "", "C:\\Windows\\explorer.exe", "", "explorer.exe"), (2, "h1", "2024-01-01 00:00:03", "200", "100", "{b}", "{a}", "C:\\Office\\WINWORD.EXE", "C:\\Windows\\explorer.exe", "winword.exe doc.docx"), (3, "h1", "2024-01-01 00:00:05", "300", "200", "", "", "C:\\Windows\\cmd.exe", "C:\\Office\\WINWORD.EXE", "cmd.exe /c whoami"),
    (4, "h1", "2024-01-01 00:00:06", "100", "300", "", "", "C:\\Windows\\powershell.exe", "C:\\Windows\\cmd.exe", "powershell -enc AAAA"), (5, "h1", "2024-01-01 00:00:07", "400", "100", "", "", "C:\\Users\\a\\AppData\\x.exe", "C:\\Windows\\powershell.exe", "x.exe"), (6, "h2", "2024-01-01 00:00:07", "500", "100", "", "", "C:\\Tools\\rclone.exe", "", "rclone copy"), (7, "h2", "2024-01-01 00:00:09", "600", "500", "", "", "C:\\Temp\\msiexec.exe", "", "msiexec /i a.msi"),
]
_PROC_SCHEMA = "id int, host string, ts string, pid string, ppid string, guid string, pguid string, image string, parent_image string, command string"
_PARENTS = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 6)]


def _user_processes(spark, d):
    rows = copies(spark, d, _PROCESSES, _PROC_SCHEMA).withColumn("id", F.col("id") + 100 * F.col("g")).withColumn("host", _of("host"))
    own = lambda c: F.when(F.col(c) != "", _of(c)).otherwise("")
    return rows.withColumns({"guid": own("guid"), "pguid": own("pguid")}).drop("g")


@query(f"SELECT id + 100 * g AS id, CAST(coalesce(parent_id + 100 * g, 0) AS BIGINT) AS parent_id FROM {copies_sql(_PARENTS, 'id, parent_id')}")
def process_parents(spark, d):
    """Parents by GUID and by PID, the same processes on hosts of every user."""
    return process.link_parents(_user_processes(spark, d)).select("id", F.coalesce("parent_id", F.lit(0).cast("long")).alias("parent_id"))


@query(f"""WITH RECURSIVE e AS {copies_sql(_PARENTS, 'id, parent_id')}, w AS (SELECT g, id, 0 AS depth, id AS root, parent_id FROM e WHERE parent_id IS NULL UNION ALL SELECT e.g, e.id, w.depth + 1, w.root, e.parent_id FROM e JOIN w ON e.parent_id = w.id AND e.g = w.g)
SELECT id + 100 * g AS id, CAST(depth AS INTEGER) AS depth, root + 100 * g AS root FROM w""")
def process_tree(spark, d):
    return process.ancestors(process.link_parents(_user_processes(spark, d)).select("id", "parent_id")).select("id", "depth", "root")


_PAIRS = [(p, c, level, *reason[:-1].split(" [")) for p, c, level, reason in chain_pairs()]
_STARTED_BY, _STARTED = (sorted({r[k] for r in _PAIRS}) for k in (0, 1))
_ALONE = [(name, level, pattern) for level, name, part, pattern in process.STANDALONE if part == "image"]
_NAMED = " ".join(f"WHEN regexp_matches(child || '.exe', '{pattern}') THEN {{}}".format("{" + str(k) + "}") for k, (_, _, pattern) in enumerate(_ALONE))
_REASON, _LEVEL = (_NAMED.format(*[repr(r[k]) for r in _ALONE]) for k in (0, 1))


@query(f"""WITH t AS (SELECT {_STARTED_BY} AS parents, {_STARTED} AS children), e AS (SELECT event_id AS id, parents[1 + event_id % {len(_STARTED_BY)}] AS parent, children[1 + event_id // {len(_STARTED_BY)} % {len(_STARTED)}] AS child FROM events, t),
a AS (SELECT *, CASE {_LEVEL} ELSE 0 END AS alone, CASE {_REASON} ELSE '' END AS alone_reason FROM e), r AS {values(_PAIRS, 'parent, child, level, reason, technique')}
SELECT id, CAST(greatest(coalesce(level, -1), alone) AS INTEGER) AS level, CASE WHEN level >= alone THEN reason ELSE alone_reason END AS reason, CASE WHEN level >= alone THEN technique ELSE '' END AS techniques FROM a LEFT JOIN r USING (parent, child)""")
def chain_rules(spark, d):
    """Every parent with every child, an event each, against all rules."""
    e, n = spark.read.parquet(f"{d}/events.parquet"), len(_STARTED_BY)
    name = lambda names, k: F.concat(F.lit("C:\\Windows\\"), F.get(F.array(*map(F.lit, names)), k.cast("int")), F.lit(".exe"))
    rows = e.select(F.col("event_id").alias("id"), name(_STARTED_BY, F.col("event_id") % n).alias("parent_image"), name(_STARTED, F.floor(F.col("event_id") / n) % len(_STARTED)).alias("image"), F.lit("").alias("command"))
    return process.assess(rows, process.default_rules(spark)).select("id", "level", "reason", "techniques")


@query(f"""SELECT event_id, id, CASE WHEN regexp_matches(command, '{process.ENCODED_PS}') THEN 3 WHEN regexp_matches(regexp_extract(lower(image), '([^\\/]*)$', 1), '{process.EXFIL_TOOLS}') THEN 2
WHEN regexp_matches(image, '{process.SUS_PATHS}') AND NOT regexp_matches(regexp_extract(lower(image), '([^\\/]*)$', 1), '{process.SAFE_PROCS}') THEN 1 ELSE 0 END AS level
FROM {cases_sql(_PROCESSES, 'id, host, ts, pid, ppid, guid, pguid, image, parent_image, command')}""".replace("[^\\/]", "[^\\\\/]"))
def standalone_patterns(spark, d):
    rows = cases(spark, d, _PROCESSES, _PROC_SCHEMA)
    return rows.select("event_id", "id", process.standalone(F.col("image"), F.col("command"))["level"].alias("level"))


# Lateral movement.

_LOGONS = [
    (4624, "2024-01-01 10:00:00", "A", "B", "bob", 3), (4624, "2024-01-01 10:05:00", "A", "B", "bob", 3), (4624, "2024-01-01 11:00:00", "B", "C", "bob", 10), (4624, "2024-01-01 12:00:00", "C", "D", "bob", 8), (4624, "2024-01-01 09:00:00", "D", "E", "amy", 3), (4624, "2024-01-01 10:00:00", "-", "B", "bob", 3), (4624, "2024-01-01 10:00:00", "A", "B", "SYSTEM", 3), (4672, "2024-01-01 10:00:00", "A", "B", "bob", 3),
]
_LOGON_SCHEMA = "event_id int, ts string, source string, target string, user string, logon_type int"


def _user_logons(spark, d):
    rows = copies(spark, d, _LOGONS, _LOGON_SCHEMA)
    return rows.withColumns({"source": F.when(F.col("source") == "-", "-").otherwise(_of("source")), "target": _of("target")}).drop("g")


@query(f"""SELECT source || '-' || g AS source, target || '-' || g AS target, "user", logon_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, '4624' AS event_ids, logon_type = 8 AS clear_text
FROM {copies_sql(_LOGONS, 'event_id, ts, source, target, "user", logon_type')} WHERE event_id = 4624 AND source <> '-' AND "user" <> 'SYSTEM' GROUP BY ALL""")
def lateral_edges(spark, d):
    return lateral.logon_edges(_user_logons(spark, d))


_CHAINS = [("A>B>C>D", 3), ("D>E", 1)]


@query(f"SELECT array_to_string(list_transform(string_split(path, '>'), lambda h: h || '-' || g), '>') AS path, hops FROM {copies_sql(_CHAINS, 'path, hops')}")
def chain_paths(spark, d):
    return lateral.chains(lateral.logon_edges(_user_logons(spark, d))).select("path", "hops")


@query(f"SELECT host || '-' || g AS host, n AS chains FROM {copies_sql([('B', 1), ('C', 1)], 'host, n')}")
def lateral_pivots(spark, d):
    return lateral.pivots(lateral.chains(lateral.logon_edges(_user_logons(spark, d))))


_HOSTS = [("DESKTOP-AB12CD3", 1), ("WIN-12345678", 1), ("kali", 1), ("myvps01", 2), ("DC01", 0), ("h\u00f6st", 1)]


@query(f"SELECT event_id, host, tier FROM {cases_sql(_HOSTS, 'host, tier')}")
def host_tiers(spark, d):
    return cases(spark, d, _HOSTS, "host string, tier int").select("event_id", "host", lateral.host_tier(F.col("host")).alias("tier"))


_REMOTE = [("cmd.exe /Q /c cd 1> \\\\127.0.0.1\\ADMIN$\\__1 2>&1", "wmiexec"), ("x __output y", "smbexec"), ("mmc.exe -Embedding", "dcomexec"), ("\\\\.\\pipe\\RemCom_communicat", "psexec"), ("notepad", None)]


@query(f"SELECT event_id, command, variant FROM {cases_sql(_REMOTE, 'command, variant')}")
def remote_execution(spark, d):
    return cases(spark, d, _REMOTE, "command string, variant string").select("event_id", "command", lateral.remote_execution(F.col("command")).alias("variant"))


_RDP = [(1149, 0, "A", "B", "u"), (21, 5, "A", "B", "u"), (22, 6, "A", "B", "u"), (4672, 7, "A", "B", "u"), (24, 600, "A", "B", "u"), (25, 700, "A", "B", "u"), (23, 900, "A", "B", "u"), (4625, 10, "A", "C", "v")]
_RDP_OUT = [("B", "u", 1, 5, "DISCONNECTED", True, False), ("B", "u", 2, 2, "ENDED", False, True), ("C", "v", 0, 1, "FAILED", False, False)]


@query(f"SELECT target || '-' || g AS target, \"user\", CAST(session AS BIGINT) AS session, n, status, admin, reconnect FROM {copies_sql(_RDP_OUT, 'target, \"user\", session, n, status, admin, reconnect')}")
def rdp_sessions(spark, d):
    rows = copies(spark, d, _RDP, "event_id int, at int, source string, target string, user string").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).withColumn("target", _of("target"))
    return lateral.rdp_sessions(rows.drop("g"), None).select("target", "user", "session", "n", "status", "admin", "reconnect")


_RDP_KEYS = [(4624, 0, "A", "B", "u", None), (21, 1, "LOCAL", "B", "u", "2"), (4624, 10, "C", "B", "u", None), (21, 11, "C", "B", "u", "3"), (4672, 20, "C", "B", "u", None), (23, 60, "", "B", "u", "3"), (25, 70, "A", "B", "u", "2")]
_RDP_KEYS_OUT = [(1, "A", "2", 2, "NO LOGOFF", False), (2, "C", "3", 4, "ENDED", False), (3, "A", "2", 1, "NO LOGOFF", False)]


@query(f"SELECT 'B-' || g AS target, CAST(session AS BIGINT) AS session, source, session_id, n, status, admin FROM {copies_sql(_RDP_KEYS_OUT, 'session, source, session_id, n, status, admin')}")
def rdp_session_keys(spark, d):
    rows = copies(spark, d, _RDP_KEYS, "event_id int, at int, source string, target string, user string, session_id string").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).withColumn("target", _of("target"))
    return lateral.rdp_sessions(rows.drop("g"), None).select("target", "session", "source", "session_id", "n", "status", "admin")


# Persistence.

_PERSIST = [
    (7045, "System", "Updater", "C:\\Users\\Public\\a.exe"), (7045, "System", "AnyDesk Service", "C:\\Program Files\\AnyDesk\\AnyDesk.exe"), (7045, "System", "CSFalcon", "C:\\Program Files\\CrowdStrike\\CSFalconService.exe"), (4698, "Security", "\\Evil", "powershell -enc AAAA"), (4698, "Security", "\\Microsoft\\Windows\\X", "svchost"),
    (5861, "Microsoft-Windows-WMI-Activity/Operational", "c", "powershell iex"), (7045, "System", "Google Chrome Elevation", "C:\\Program Files\\Google\\Chrome\\e.exe"), (4624, "Security", "", ""),
]
_PERSIST_OUT = [("Updater", "Services", 7, "High", "User-writable path", False), ("AnyDesk Service", "Services", 6, "High", "", True), ("\\Evil", "Scheduled Tasks", 6, "High", "Non-standard task path|LOLBin execution", False), ("\\Microsoft\\Windows\\X", "Scheduled Tasks", 4, "Medium", "", False), ("c", "WMI Persistence", 10, "Critical", "LOLBin execution", False), ("Google Chrome Elevation", "Services", 2, "Low", "", False)]


@query(f"SELECT g, name, category, risk, severity, badges, rmm FROM {copies_sql(_PERSIST_OUT, 'name, category, risk, severity, badges, rmm')}")
def persistence_events(spark, d):
    """Badges, remote tools, vendors and updaters, the same events for every user."""
    return persistence.event_findings(copies(spark, d, _PERSIST, "event_id int, channel string, name string, command string")).select("g", "name", "category", "risk", "severity", "badges", "rmm")


_REG = [("HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run", "x", "C:\\Temp\\a.exe", "Run / RunOnce", 5), ("HKLM\\SYSTEM\\CurrentControlSet\\Control\\Lsa", "Security Packages", "a", "LSA Packages", 8), ("HKLM\\SOFTWARE\\Other", "x", "y", None, 0)]


@query(f"SELECT event_id, key, location, risk FROM {cases_sql(_REG, 'key, value_name, value_data, location, risk')} WHERE location IS NOT NULL")
def persistence_registry(spark, d):
    return persistence.registry_findings(cases(spark, d, _REG, "key string, value_name string, value_data string, want string, want_risk int")).select("event_id", "key", "location", "risk")


@query("SELECT conv_id AS block_id, string_agg(text, '' ORDER BY turn) AS script, count(*) = 4 AS complete FROM conversations GROUP BY 1")
def script_blocks(spark, d):
    pieces = read(spark, d, "conversations").select(F.col("conv_id").alias("block_id"), F.col("turn").alias("number"), "text", F.lit(4).alias("total"))
    return persistence.script_blocks(pieces)


# Indicators.


@query("SELECT b.text AS ioc, count(d.doc_id) AS hits FROM benchmark b LEFT JOIN documents d ON contains(lower(concat_ws(chr(1), d.text, d.source)), lower(b.text)) GROUP BY 1")
def ioc_match_counts(spark, d):
    iocs = read(spark, d, "benchmark").select(F.col("text").alias("ioc"))
    return ioc.hit_counts(iocs, ioc.match(read(spark, d, "documents"), iocs, ["text", "source"], "doc_id"))


_VERDICTS = [("evil.com", 5, 0, 70), ("1.2.3.4", 0, 2, 80), ("good.org", 0, 0, 60)]
_ENRICHED = [("EVIL.com", "malicious", 5 / 70), ("1.2.3.4:443", "suspicious", 2 / 80), ("good.org", "clean", 0.0), ("none.net", "not_found", 0.0)]


@query(f"SELECT CASE ioc WHEN '1.2.3.4:443' THEN '10.' || g || '.3.4:443' ELSE g || ioc END AS ioc, verdict, CAST(score AS DOUBLE) AS score FROM {copies_sql(_ENRICHED, 'ioc, verdict, score')}")
def verdict_enrichment(spark, d):
    own = lambda c, ip: F.when(F.col(c).startswith("1.2.3.4"), F.concat(F.lit("10."), F.col("g").cast("string"), F.lit(ip))).otherwise(F.concat(F.col("g").cast("string"), F.col(c)))
    iocs = copies(spark, d, _ENRICHED, "ioc string, w string, s double").select(own("ioc", ".3.4:443").alias("ioc"))
    verdicts = copies(spark, d, _VERDICTS, "key string, malicious int, suspicious int, total int").withColumn("key", own("key", ".3.4")).drop("g")
    return ioc.enrich(iocs, verdicts)


# File system.

_ENTRIES = [(6, 5, "a"), (7, 6, "b"), (30, 99, "z"), (20, 21, "x"), (21, 20, "y")]
_PATHS = [(5, "."), (6, ".\\a"), (7, ".\\a\\b"), (30, ".\\[ORPHAN]\\z"), (20, ".\\[ORPHAN]\\y\\x"), (21, ".\\[ORPHAN]\\x\\y"), (99, ".\\[ORPHAN]")]


@query(f"SELECT DISTINCT CASE WHEN entry = 5 THEN 5 ELSE entry + 1000 * g END AS entry, path FROM {copies_sql(_PATHS, 'entry, path')}")
def parent_paths(spark, d):
    own = lambda c: F.when(F.col(c) == 5, F.lit(5).cast("long")).otherwise(F.col(c) + 1000 * F.col("g")).alias(c)
    return ntfs.parent_paths(copies(spark, d, _ENTRIES, "entry long, parent long, name string").select(own("entry"), own("parent"), "name"))


_JOURNAL = [(1, 10, 1, 5, 1, "old", True, "FileCreate"), (2, 11, 1, 10, 1, "f.exe", False, "FileCreate|Close"), (3, 10, 2, 5, 1, "new", True, "RenameNewName"), (4, 12, 1, 10, 2, "g.zip", False, "DataExtend"), (5, 11, 1, 10, 1, "f.exe", False, "FileDelete|Close")]
_J_SCHEMA = "usn long, entry long, seq int, parent_entry long, parent_seq int, name string, is_dir boolean, reasons string"
_J_PARENTS = [(1, None), (2, "old"), (3, None), (4, "new"), (5, "old")]


def _user_journal(spark, d):
    own = lambda c: F.when(F.col(c) == 5, F.lit(5).cast("long")).otherwise(F.col(c) + 1000 * F.col("g"))
    rows = copies(spark, d, _JOURNAL, _J_SCHEMA)
    return rows.withColumns({"usn": F.col("usn") + 1_000_000 * F.col("g"), "entry": own("entry"), "parent_entry": own("parent_entry")}).drop("g")


@query(f"SELECT usn + 1000000 * g AS usn, parent_name FROM {copies_sql(_J_PARENTS, 'usn, parent_name')}")
def journal_parents(spark, d):
    return ntfs.journal_parents(_user_journal(spark, d)).select("usn", "parent_name")


_J_CATS = [(1, "creations"), (2, "creations"), (2, "execution"), (2, "close patterns"), (3, "renames"), (4, "exfiltration"), (5, "deletions"), (5, "close patterns")]


@query(f"SELECT g, CAST(usn AS BIGINT) AS usn, category FROM {copies_sql(_J_CATS, 'usn, category')}")
def journal_categories(spark, d):
    rows = copies(spark, d, _JOURNAL, _J_SCHEMA).withColumn("path", F.concat(F.lit(".\\x\\"), F.col("name")))
    return ntfs.journal_categories(rows).select("g", "usn", "category")


@query("SELECT 11 + 1000 * user_id AS entry, 'f.exe: FileCreate|Close > f.exe: FileDelete|Close' AS story FROM (SELECT DISTINCT user_id FROM events)")
def journal_chains(spark, d):
    return ntfs.file_chains(_user_journal(spark, d)).where("entry % 1000 = 11").select("entry", "story")


_STAMPS = [(1, "a.exe", 100_000_000_003, 100_000_000_004, 10**15, 10**15, "critical"), (2, "b.txt", 10**15 - 10**10 * 4 + 1, 10**15 + 1, 10**15, 10**15, "medium"), (3, "c.txt", 10**15 + 7, 10**15 + 8, 10**15, 10**15, None), (4, "d.txt", 10**15 + 9, 10**14 + 1, 10**15, 10**15, "high")]


@query(f"SELECT event_id, entry, severity FROM {cases_sql(_STAMPS, 'entry, name, a, b, c, e, severity')} WHERE severity IS NOT NULL")
def timestomping(spark, d):
    rows = cases(spark, d, _STAMPS, "entry int, name string, si_created long, si_modified long, fn_created long, fn_modified long, want string")
    return ntfs.timestomping(rows).select("event_id", "entry", "severity")


@query("SELECT event_id AS entry, CAST(user_id % 4 AS INTEGER) AS zone, 'http://a/' || user_id AS referrer, 'http://a/' || event_type || '.exe' AS host_url FROM events")
def alternate_streams(spark, d):
    user = F.col("user_id").cast("string")
    zone = F.concat(F.lit("[ZoneTransfer]\r\nZoneId="), (F.col("user_id") % 4).cast("string"), F.lit("\r\nReferrerUrl=http://a/"), user, F.lit("\r\nHostUrl=http://a/"), "event_type", F.lit(".exe\r\n"))
    return ntfs.streams(read(spark, d, "events").select(F.col("event_id").alias("entry"), zone.alias("zone_contents")))


@query("""SELECT count(*) FILTER (WHERE ends_with(lower(event_type || '.k'), 'or.k')) AS files, CAST(sum(event_id) FILTER (WHERE event_type = 'error') AS BIGINT) AS bytes, min(ts) FILTER (WHERE event_type = 'error') AS first_ts, max(ts) FILTER (WHERE event_type = 'error') AS last_ts,
count(*) FILTER (WHERE contains(event_type, 'sign')) AS notes, round(count(*) FILTER (WHERE event_type = 'error') / ((epoch_us(max(ts) FILTER (WHERE event_type = 'error')) - epoch_us(min(ts) FILTER (WHERE event_type = 'error'))) / 6e7), 9) AS files_per_minute, round((epoch_us(max(ts) FILTER (WHERE event_type = 'error')) - epoch_us(min(ts) FILTER (WHERE event_type = 'error'))) / 6e7, 6) AS duration_minutes FROM events""")
def ransomware_rollup(spark, d):
    files = read(spark, d, "events").select(F.concat("event_type", F.lit(".k")).alias("name"), F.col("event_id").alias("size"), "ts")
    return ntfs.ransomware(files, "or.k", "sign").withColumn("files_per_minute", F.round("files_per_minute", 9)).withColumn("duration_minutes", F.round("duration_minutes", 6))


@query("SELECT event_type AS parent_path, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS slot, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5")
def directory_incidents(spark, d):
    return ntfs.directory_incidents(read(spark, d, "events").select(F.col("event_type").alias("parent_path"), "ts"), 60, 5)


@query("""WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'renames' WHEN 'error' THEN 'deletions' ELSE 'execution' END AS category, 'd' || (user_id % 7) AS parent_path, ts FROM events),
p AS (SELECT category, parent_path, count(*) AS k, min(ts) AS a, max(ts) AS b FROM c GROUP BY 1, 2),
f AS (SELECT category, CAST(sum(k) AS BIGINT) AS n, count(*) AS folders, min(a) AS first_ts, max(b) AS last_ts, arg_max(parent_path, struct_pack(k := k, p := parent_path)) AS top_folder FROM p GROUP BY 1),
s AS (SELECT *, round(CASE category WHEN 'execution' THEN 4 ELSE 2 END * log2(1 + n), 3) AS score FROM f)
SELECT *, row_number() OVER (ORDER BY score DESC, category) AS rank FROM s""")
def journal_findings(spark, d):
    kind = F.when(F.col("event_type") == "click", "renames").when(F.col("event_type") == "error", "deletions").otherwise("execution")
    rows = read(spark, d, "events").select(kind.alias("category"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("parent_path"), "ts")
    return ntfs.journal_findings(rows)
