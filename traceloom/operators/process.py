"""Process inspection: roles, parent links, tree, chain rules and standalone patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_table, materialize, shuffles_dropped
from .chain_rules import rules as chain_pairs

# Patterns on command lines, paths and process names.
SUS_PATHS = r"(?i)(\\temp\\|\\tmp\\|\\appdata\\|\\downloads\\|\\public\\|\\recycle|\\perflogs\\|\\videos\\|\\music\\|\\pictures\\)"
SAFE_PROCS = r"(?i)^(mpcmdrun|msmpeng|dismhost|monagentcore|monagenthost|monagentmanager|monagentlauncher|metricsextension\.native|cleanmgr|tiworker|wuauclt|setup|msiexec|drvinst|trustedinstaller|taskhostw|backgroundtaskhost|runtimebroker|searchprotocolhost|searchindexer|searchfilterhost|microsoftedgeupdate|googleupdate|onedrive|onedriveupdater|wermgr|werfault|compattelrunner)(\.exe)?$"
ENCODED_PS = r"(?i)\s+(-e\s|-enc\s|-encodedcommand\s|-en\s|-ec\s)"
CRED_DUMP_CMD = r"(?i)(comsvcs\.dll|sekurlsa|lsadump|procdump.*lsass|mimikatz|pypykatz|nanodump)"
NTDS_EXTRACT = r"(?i)(ntdsutil.*ifm|wbadmin.*ntds|secretsdump|ntds\.dit)"
LSASS_TOOLS = r"(?i)^(processhacker|procdump|sqldumper|avdump|handlekatz)(\.exe)?$"
ACCOUNT_MANIP = r"(?i)net\s+(user|group|localgroup)\s+.*(/add|/domain\s+/add)"
DEFENSE_EVASION = r"(?i)(vssadmin.*delete|wevtutil\s+cl|bcdedit.*safeboot|bcdedit.*recoveryenabled)"
NETWORK_SCANNERS = r"(?i)^(netscan|netscan64|advanced_ip_scanner|rustscan|masscan|angry_ip_scanner|nbtscan)(\.exe)?$"
AD_RECON_TOOLS = r"(?i)^(adfind|sharphound|bloodhound|sharpview|seatbelt|rubeus|certify|certipy)(\.exe)?$"
RMM_TOOLS = r"(?i)^(anydesk|splashtop|rustdesk|atera|screenconnect|teamviewer|supremo)(\.exe)?$"
EXFIL_TOOLS = r"(?i)^(rclone|filezilla|winscp|megasync|megacmd)(\.exe)?$"
ARCHIVE_SUSPECT = r"(?i)\b(7z|7za|winrar|rar)\b.*(-p| a .*\.(7z|zip|rar))"

# (level, reason, part of the process, pattern); 3 critical, 2 high, 1 medium. The first of the highest level wins.
STANDALONE = (
    (3, "Encoded PowerShell", "command", ENCODED_PS), (3, "Credential dumping", "command", CRED_DUMP_CMD), (3, "NTDS extraction", "command", NTDS_EXTRACT), (3, "LSASS access tool", "image", LSASS_TOOLS),
    (2, "Account manipulation", "command", ACCOUNT_MANIP), (2, "Defense evasion", "command", DEFENSE_EVASION), (2, "Exfiltration tool", "image", EXFIL_TOOLS), (2, "Suspicious archive operation", "command", ARCHIVE_SUSPECT),
    (1, "Network scanner", "image", NETWORK_SCANNERS), (1, "AD recon tool", "image", AD_RECON_TOOLS), (1, "Remote management tool", "image", RMM_TOOLS), (1, "Suspicious path", "path", SUS_PATHS),
)


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^\\/]*)$", 1))


def process_roles(df: DataFrame, kind: str = "sysmon") -> DataFrame:
    """Process creations with common names: pid, ppid, guid, pguid, image, parent_image, command, user, host, ts.

    kind: sysmon (event 1) or security (event 4688, where ProcessId is the parent and ids are hexadecimal).
    """
    from ..functions.text import hex_to_decimal

    pick = lambda *names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in df.columns], F.lit(""))
    if kind == "sysmon":
        roles = {"ts": pick("UtcTime", "datetime"), "pid": pick("ProcessId"), "ppid": pick("ParentProcessId"), "guid": pick("ProcessGuid"), "pguid": pick("ParentProcessGuid"), "image": pick("Image"), "parent_image": pick("ParentImage"), "user": pick("User")}
        rows = df.where(F.col("EventID").cast("string") == "1")
    else:
        roles = {"ts": pick("datetime", "UtcTime"), "pid": hex_to_decimal(pick("NewProcessId")), "ppid": hex_to_decimal(pick("ProcessId")), "guid": F.lit(""), "pguid": F.lit(""), "image": pick("NewProcessName"), "parent_image": pick("ParentProcessName"), "user": pick("TargetUserName", "SubjectUserName")}
        rows = df.where(F.col("EventID").cast("string") == "4688")
    roles |= {"host": pick("Computer"), "command": pick("CommandLine")}
    return rows.select(*([F.col("_rowid")] if "_rowid" in df.columns else []), *[v.alias(k) for k, v in roles.items()])


def link_parents(processes: DataFrame, id_col: str = "id") -> DataFrame:
    """processes with parent_id: by GUID, else the latest earlier process of the host with the parent's PID, else null.

    The PID link is a union and a window (a child at its parent's instant is later than it), linear in the rows.
    """
    p = processes
    by_guid = p.where("guid <> ''").groupBy(F.col("guid").alias("pguid")).agg(F.min(id_col).alias("guid_parent"))
    linked = p.join(by_guid, "pguid", "left")
    starts = p.select("host", F.col("pid").alias("key"), "ts", F.lit(0).alias("kind"), F.col(id_col).alias("parent"), F.lit(None).cast(p.schema[id_col].dataType).alias("child"))
    asks = p.select("host", F.col("ppid").alias("key"), "ts", F.lit(1).alias("kind"), F.lit(None).cast(p.schema[id_col].dataType).alias("parent"), F.col(id_col).alias("child"))
    before = Window.partitionBy("host", "key").orderBy("ts", "kind", "parent").rowsBetween(Window.unboundedPreceding, -1)
    # Where the last start is the process itself, whose parent had the same PID, the start before it is the parent.
    both = starts.unionByName(asks).withColumn("previous", F.last("parent", ignorenulls=True).over(before))
    last = F.last(F.when(F.col("kind") == 0, F.struct("parent", "previous")), ignorenulls=True).over(before)
    found = both.withColumn("last", last).where("kind = 1").select(F.col("child").alias(id_col), F.when(F.col("last.parent") == F.col("child"), F.col("last.previous")).otherwise(F.col("last.parent")).alias("pid_parent"))
    out = linked.join(found, id_col, "left")
    parent = F.coalesce("guid_parent", F.when(F.col("pid_parent") != F.col(id_col), F.col("pid_parent")))
    return out.withColumn("parent_id", F.when(parent != F.col(id_col), parent)).drop("guid_parent", "pid_parent")


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, depth, root, ancestors) of every node of (id, parent_id): pointer doubling, so log2(depth) joins.

    The rounds are written one by one until no node has an ancestor left to add, however deep the tree is. A node whose
    ancestors form a cycle stops before the first repeated id.
    """
    none = F.array().cast(f"array<{edges.schema['id'].dataType.simpleString()}>")
    state = materialize(edges.select("id", F.col("parent_id").alias("next"), F.when(F.col("parent_id").isNotNull(), F.array("parent_id")).otherwise(none).alias("path")), "ancestors")
    while not state.where("next IS NOT NULL").isEmpty():
        up = state.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("path").alias("more"))
        joined = state.join(up, "next", "left").withColumn("more", F.coalesce("more", none))
        again = F.array_intersect("more", F.concat("path", F.array("id")))
        first = F.array_min(F.transform(again, lambda x: F.array_position("more", x))).cast("int")
        fresh = F.when(F.size(again) > 0, F.slice("more", F.lit(1), first - 1)).otherwise(F.col("more"))
        before, state = state, materialize(joined.select("id", F.when(F.size(again) == 0, F.col("after")).alias("next"), F.concat("path", fresh).alias("path")), "ancestors")
        drop_table(before)
    depth = F.size("path")
    return state.select("id", depth.alias("depth"), F.when(depth > 0, F.element_at("path", -1)).otherwise(F.col("id")).alias("root"), F.col("path").alias("ancestors"))


def depths(edges: DataFrame) -> DataFrame:
    """(id, depth, root) of every node of (id, parent_id), as ancestors() has them, without the lists of ancestors.

    Pointer doubling on numbers: a row says which ancestor it has come to in how many steps, so a table of a round has a row
    a node however deep the trees are. Every round ends some node of a tree; what is left when one ends none leads into
    cycles, and its ancestors are listed.
    """
    spark, parent = edges.sparkSession, F.col("parent_id")
    state = materialize(edges.select("id", F.coalesce(parent, "id").alias("at"), parent.isNotNull().cast("long").alias("steps"), parent.isNull().alias("done")), "depths")
    left, last = state.where("NOT done").count(), -1
    with shuffles_dropped(spark):
        while left not in (0, last):
            up = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
            joined = state.where("NOT done").join(up, "at", "left")  # an ancestor that is no node is the last one
            moved = joined.select("id", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("ends", F.lit(True)).alias("done"))
            before, state = state, materialize(state.where("done").unionByName(moved), "depths")
            drop_table(before)
            left, last = state.where("NOT done").count(), left
    found = state.where("done").select("id", F.col("steps").cast("int").alias("depth"), F.col("at").alias("root"))
    if left:
        cyclic = edges.join(state.where("NOT done").select("id"), "id").select("id", "parent_id")
        found = found.unionByName(ancestors(cyclic).select("id", "depth", "root"))
    return found


def chain_rule_table(rules: DataFrame) -> DataFrame:
    """One row per (parent, child) without .exe: the highest level, the first of equal ones; techniques taken from the text.

    rules: (position, parent, child, level, reason).
    """
    strip = lambda c: F.regexp_replace(F.lower(c), r"\.exe$", "")
    keyed = rules.select(strip(F.col("parent")).alias("parent_key"), strip(F.col("child")).alias("child_key"), "level", "position", "reason")
    best = keyed.groupBy("parent_key", "child_key").agg(F.min(F.struct((-F.col("level")).alias("l"), "position", "reason")).alias("b"))
    text = F.col("b.reason")
    return best.select("parent_key", "child_key", (-F.col("b.l")).alias("chain_level"), F.trim(F.regexp_replace(text, r"\s*\[T\d{4}(\.\d{3})?\]", "")).alias("chain_reason"), F.array_join(F.regexp_extract_all(text, F.lit(r"\bT\d{4}(?:\.\d{3})?\b"), F.lit(0)), ",").alias("techniques"))


def default_rules(spark) -> DataFrame:
    """The built-in rules; other tables of the same columns do as well."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(chain_pairs())], "position int, parent string, child string, level int, reason string")


def standalone(image: Column, command: Column) -> Column:
    """(level, reason) of the first highest pattern that fits a process; known-safe processes have no path finding."""
    name = base_name(image)
    where = {"command": F.coalesce(command, F.lit("")), "image": name, "path": F.coalesce(image, F.lit(""))}
    out = F.struct(F.lit(0).alias("level"), F.lit("").alias("reason"))
    for level, reason, part, pattern in reversed(STANDALONE):
        hit = where[part].rlike(pattern) & (~name.rlike(SAFE_PROCS) if part == "path" else F.lit(True))
        out = F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def assess(processes: DataFrame, rules: DataFrame) -> DataFrame:
    """processes with level, reason and techniques: the higher of chain rule and standalone pattern (the chain on a tie)."""
    strip = lambda c: F.regexp_replace(base_name(c), r"\.exe$", "")
    keyed = processes.withColumn("parent_key", strip(F.col("parent_image"))).withColumn("child_key", strip(F.col("image"))).withColumn("alone", standalone(F.col("image"), F.col("command")))
    joined = keyed.join(chain_rule_table(rules), ["parent_key", "child_key"], "left")
    chain = F.coalesce("chain_level", F.lit(-1))
    wins = (chain >= F.col("alone.level")) & (chain >= 0)
    return joined.select(*processes.columns, F.greatest(chain, F.col("alone.level")).alias("level"), F.when(wins, F.col("chain_reason")).otherwise(F.col("alone.reason")).alias("reason"), F.when(wins, F.col("techniques")).otherwise("").alias("techniques"))


def capped(processes: DataFrame, order: list[str], most: int = 200_000) -> DataFrame:
    """The first processes in an order, with truncated: whether there are more of them than `most`."""
    top = processes.orderBy(*order).limit(most + 1)
    numbered = top.withColumn("__k", F.row_number().over(Window.orderBy(*order)))  # over at most most + 1 rows
    return numbered.withColumn("truncated", F.max("__k").over(Window.partitionBy(F.lit(1))) > most).where(F.col("__k") <= most).drop("__k")


def view(assessed: DataFrame, mode: str = "triage") -> DataFrame:
    """raw: all; hunt: medium and up; triage: suspicious, one row per (host, image, command).

    Where a profile has marked findings as suppressed, hunt and triage leave them out and raw shows them.
    """
    if mode == "raw":
        return assessed
    found = assessed.where(F.col("level") >= 1)
    if "suppressed" in assessed.columns:
        found = found.where(~F.coalesce("suppressed", F.lit(False)))
    return found if mode == "hunt" else found.dropDuplicates(["host", "image", "command"])
