"""Persistence: indicators in event logs and registry exports, risk, badges and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (event id, channel pattern, category, description). The base of the risk is ours.
EVENT_RULES = (
    (7045, "system", "Services", "New service installed"), (4697, "security", "Services", "Service installed (auditing)"), (4698, "security", "Scheduled Tasks", "Scheduled task created"), (4699, "security", "Scheduled Tasks", "Scheduled task deleted"), (106, "taskscheduler", "Scheduled Tasks", "Task registered"), (129, "taskscheduler", "Scheduled Tasks", "Task launch attempt"),
    (118, "taskscheduler", "Scheduled Tasks", "Boot trigger fired"), (119, "taskscheduler", "Scheduled Tasks", "Logon trigger fired"), (140, "taskscheduler", "Scheduled Tasks", "Task updated"), (141, "taskscheduler", "Scheduled Tasks", "Task deleted"), (200, "taskscheduler", "Scheduled Tasks", "Task action started"), (5861, "wmi-activity", "WMI Persistence", "WMI permanent event consumer registered"),
    (19, "sysmon", "WMI Persistence", "WMI event filter created"), (20, "sysmon", "WMI Persistence", "WMI event consumer created"), (21, "sysmon", "WMI Persistence", "WMI filter-to-consumer binding"), (13, "sysmon", "Registry Autorun", "Registry value set (autorun modifications)"), (12, "sysmon", "Registry Modification", "Registry key created or deleted"), (14, "sysmon", "Registry Rename", "Registry key or value renamed"),
    (11, "sysmon", "Startup Folder", "File created in startup directory"), (7, "sysmon", "DLL Hijacking", "Unsigned or suspicious DLL loaded"), (6, "sysmon", "Driver Loading", "Suspicious driver loaded"), (25, "sysmon", "Process Tampering", "Process tampering detected"), (2, "sysmon", "Timestomping", "File creation time changed"), (15, "sysmon", "Alternate Data Stream", "Stream created"),
    (4720, "security", "Account Persistence", "User account created"), (4724, "security", "Account Persistence", "Password reset attempt"), (4728, "security", "Account Persistence", "Member added to global security group"), (4732, "security", "Account Persistence", "Member added to local security group"), (4756, "security", "Account Persistence", "Member added to universal security group"),
)
BASE = {"Services": 6, "Scheduled Tasks": 4, "WMI Persistence": 8, "Registry Autorun": 4, "DLL Hijacking": 6, "Driver Loading": 6, "Process Tampering": 8, "Account Persistence": 4}
REGISTRY_RULES = (
    ("Run / RunOnce", r"(?i)\\CurrentVersion\\Run(Once)?($|\\)", 4), ("Services", r"(?i)\\Services\\[^\\]+\\?(ImagePath)?$", 6), ("Winlogon", r"(?i)\\Winlogon($|\\)", 6), ("AppInit_DLLs", r"(?i)AppInit_DLLs", 8), ("IFEO Debugger", r"(?i)\\Image File Execution Options\\", 8), ("COM Hijacking", r"(?i)\\CLSID\\.*\\(InprocServer32|LocalServer32)", 6),
    ("Shell Extensions", r"(?i)ShellIconOverlayIdentifiers|Shell ?Extensions", 4), ("BootExecute", r"(?i)\\Session Manager($|\\)", 6), ("BHO", r"(?i)Browser Helper Objects", 4), ("LSA Packages", r"(?i)\\Lsa($|\\)", 8), ("Print Monitors", r"(?i)\\Print\\Monitors\\", 6), ("Active Setup", r"(?i)\\Active Setup\\Installed Components\\", 4),
    ("Startup Folder", r"(?i)\\User Shell Folders", 4), ("Scheduled Tasks", r"(?i)\\Schedule\\TaskCache\\Tasks", 4), ("Network Providers", r"(?i)\\NetworkProvider\\Order", 6),
)
RISKY_PATH = r"(?i)\\(temp|appdata|downloads|programdata|public|users)\\"
LOLBIN = r"(?i)\b(powershell|pwsh|cmd(\.exe)?\b|mshta|wscript|cscript|rundll32|regsvr32|certutil|bitsadmin)"
CRADLE = r"(?i)(-e(nc|c|ncodedcommand)?\s|\biex\b|invoke-expression|downloadstring|webclient|bitstransfer|frombase64string)"
VENDOR_PATH = r"(?i)\\(program files( \(x86\))?|programdata)\\(cyvera|palo alto|windows defender|microsoft\\windows defender|crowdstrike|sentinelone|carbon ?black|sophos|symantec|mcafee|trellix|kaspersky|eset|trend micro|bitdefender|cylance|elastic|fortinet)"
BROWSER = r"(?i)(chrome|edge|firefox|brave|opera|vivaldi)"
RMM_SERVICE = r"(?i)(anydesk|splashtop|rustdesk|atera|screenconnect|teamviewer|supremo|connectwise|bomgar|logmein)"


def risk(base: Column, command: Column) -> Column:
    """0 to 10: the category's base, 1 more each for a risky path, a living-off-the-land binary, an encoding or cradle."""
    more = [F.when(command.rlike(p), 1).otherwise(0) for p in (RISKY_PATH, LOLBIN, CRADLE)]
    return F.least(F.lit(10), base + more[0] + more[1] + more[2])


def band(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 6, "High").when(score >= 3, "Medium").otherwise("Low")


def badges(event_id: Column, name: Column, command: Column) -> Column:
    """The suspicious-behaviour badges of a finding, joined by `|`."""
    task = event_id.isin(4698, 4699, 106, 118, 119, 129, 140, 141, 200)
    known = name.rlike(r"(?i)^\\?(Microsoft|Google|Mozilla|Adobe|Apple)\\")
    each = (
        ("Non-standard task path", task & ~known), ("GUID-named task", task & name.rlike(r"^\\?\{[0-9A-Fa-f-]{36}\}$")), ("LOLBin execution", ~known & command.rlike(r"(?i)\b(powershell|cmd\.exe|mshta|wscript|cscript)\b")),
        ("User-writable path", command.rlike(r"(?i)\\(users|temp|appdata|downloads|public)\\")), ("Non-standard task deleted", (event_id == 141) & ~known), ("Browser mimicry", event_id.isin(7045, 4697) & name.rlike(BROWSER) & ~command.rlike(r"(?i)\\program files")),
    )
    return F.concat_ws("|", *[F.when(hit, F.lit(label)) for label, hit in each])


def event_findings(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings of (event_id, channel, name, command, ...) rows: category, description, risk, severity, badges and rmm.

    Services of protection vendors in their own folders are left out; browser updaters in Program Files are low.
    """
    rules = rules if rules is not None else event_rules(events.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = events.join(rules, "event_id").where(F.contains(F.replace(F.lower(text("channel")), F.lit("-"), F.lit("")), F.replace(F.col("channel_part"), F.lit("-"), F.lit(""))))
    service = F.col("category") == "Services"
    kept = joined.where(~(service & text("command").rlike(VENDOR_PATH)))
    updater = service & text("name").rlike(BROWSER) & text("command").rlike(r"(?i)\\program files")
    score = F.when(updater, F.lit(2)).otherwise(risk(F.col("base"), text("command")))
    return kept.select(*events.columns, "category", "description", score.alias("risk"), band(score).alias("severity"), badges(F.col("event_id"), text("name"), text("command")).alias("badges"), (service & text("name").rlike(RMM_SERVICE)).alias("rmm"))


def input_mode(columns: Sequence[str]) -> str:
    """registry or events, by the headers of a table; events where neither kind is there."""
    names = {c.lower() for c in columns}
    registry = sum(bool(names & group) for group in ({"keypath", "key"}, {"valuename", "value_name"}, {"valuedata", "value_data"}))
    events = sum(bool(names & group) for group in ({"eventid", "event_id"}, {"channel"}, {"provider"}))
    return "registry" if registry > events else "events"


SEVERITY_BASE = {"critical": 9, "high": 6, "medium": 3, "low": 1}


def with_custom_events(rules: DataFrame, custom: Sequence[dict], off: Sequence[str] = ()) -> DataFrame:
    """A table of event rules without the descriptions that are switched off and with an analyst's own rules.

    custom: category, name, event_ids, channels (perhaps none) and severity; a payload pattern is for custom_payload().
    """
    rows = [(int(e), (ch or "").lower(), c["category"], c["name"], SEVERITY_BASE[c["severity"].lower()]) for c in custom for e in c["event_ids"] for ch in (c.get("channels") or [""])]
    kept = rules.where(~F.col("description").isin(*off)) if off else rules
    return kept.unionByName(rules.sparkSession.createDataFrame(rows, rules.schema)) if rows else kept


def custom_payload(findings: DataFrame, custom: Sequence[dict], payload: str = "command") -> DataFrame:
    """Findings without those of an own rule whose payload pattern does not fit."""
    for c in custom:
        if c.get("payload"):
            findings = findings.where((F.col("description") != c["name"]) | F.coalesce(F.col(payload).rlike("(?i)" + c["payload"]), F.lit(False)))
    return findings


def event_rules(spark) -> DataFrame:
    """The built-in event rules as a table."""
    return spark.createDataFrame([(*r, BASE.get(r[2], 2)) for r in EVENT_RULES], "event_id int, channel_part string, category string, description string, base int")


def registry_findings(values: DataFrame, custom: Sequence[dict] = (), off: Sequence[str] = ()) -> DataFrame:
    """Findings of (key, value_name, value_data) rows at the known locations; the first location that fits counts.

    custom: an analyst's own rules (name, key pattern, value_name pattern or none, severity), tried after the built-in ones;
    off: names of built-in rules that are switched off.
    """
    where = F.concat_ws("\\", F.coalesce("key", F.lit("")), F.coalesce("value_name", F.lit("")))
    found = F.lit(None).cast("struct<location:string,base:int>")
    for c in reversed(custom):
        hit = F.col("key").rlike("(?i)" + c["key"])
        if c.get("value_name"):
            hit = hit & F.col("value_name").rlike("(?i)" + c["value_name"])
        found = F.when(hit, F.struct(F.lit(c["name"]).alias("location"), F.lit(SEVERITY_BASE[c["severity"].lower()]).alias("base"))).otherwise(found)
    for name, pattern, base in reversed([r for r in REGISTRY_RULES if r[0] not in off]):
        found = F.when(F.col("key").rlike(pattern) | where.rlike(pattern), F.struct(F.lit(name).alias("location"), F.lit(base).alias("base"))).otherwise(found)
    rows = values.withColumn("__f", found).where("__f IS NOT NULL")
    score = risk(F.col("__f.base"), F.coalesce("value_data", F.lit("")))
    return rows.select(*values.columns, F.col("__f.location").alias("location"), score.alias("risk"), band(score).alias("severity"))


def task_command(xml: Column) -> Column:
    """Command and arguments in a task definition."""
    return F.trim(F.concat_ws(" ", F.regexp_extract(xml, r"(?s)<Command>(.*?)</Command>", 1), F.regexp_extract(xml, r"(?s)<Arguments>(.*?)</Arguments>", 1)))


def correlate(findings: DataFrame, definitions: DataFrame) -> DataFrame:
    """findings with binary: a task's command from its definition (4698), a service's image path (7045, 4697), else ''.

    definitions: (name, xml) of tasks.
    """
    known = definitions.groupBy("name").agg(task_command(F.min("xml")).alias("__task"))
    service = F.col("event_id").isin(7045, 4697)
    binary = F.when(service, F.coalesce("command", F.lit(""))).otherwise(F.coalesce("__task", F.lit("")))
    return findings.join(known, "name", "left").withColumn("binary", binary).drop("__task")


def link_wmi(filters: DataFrame, consumers: DataFrame, bindings: DataFrame) -> DataFrame:
    """One finding per binding: (filter_name, consumer_name) with the filter's query and the consumer's command."""
    return bindings.join(filters, "filter_name", "left").join(consumers, "consumer_name", "left").select("filter_name", "consumer_name", "query", "command")


def script_blocks(pieces: DataFrame) -> DataFrame:
    """Whole scripts of (block_id, number, total, text): text in order and whether all pieces are there."""
    grouped = pieces.groupBy("block_id").agg(F.array_sort(F.collect_set(F.struct("number", "text"))).alias("p"), F.max("total").alias("total"))
    return grouped.select("block_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("script"), (F.size("p") == F.col("total")).alias("complete"))


def account_chains(events: DataFrame, within_seconds: int = 86_400) -> DataFrame:
    """Accounts created (4720) and then added to a group (4728, 4732, 4756) within the time: (account, created, added, groups)."""
    from .temporal import seconds

    made = events.where("event_id = 4720").groupBy("account").agg(F.min("ts").alias("created"))
    added = events.where("event_id IN (4728, 4732, 4756)").select("account", F.col("ts").alias("at"))
    near = made.join(added, "account").where((F.col("at") >= F.col("created")) & (seconds(F.col("at")) - seconds(F.col("created")) <= within_seconds))
    return near.groupBy("account", "created").agg(F.min("at").alias("added"), F.count(F.lit(1)).alias("groups"))
