"""File-system analysis: paths, time stamps, streams, ransomware and the change journal."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entropy, extension
from ..functions.timestamps import zero_subsecond
from ..storage import materialize
from .process import ancestors
from .temporal import carried

ROOT = 5
EXECUTABLE = (".exe", ".dll", ".sys", ".ps1", ".bat", ".vbs", ".js", ".scr")


def parent_paths(entries: DataFrame) -> DataFrame:
    """(entry, path): `.\\a\\b` from the root, entry 5; a missing ancestor or a cycle gives `.\\[ORPHAN]\\...`.

    entries: (entry, parent, name). Ancestors by pointer doubling, then one join for the names.
    """
    tree = entries.groupBy("entry").agg(F.min(F.struct("parent", "name")).alias("e")).select("entry", "e.parent", "e.name")
    asked = tree.select("entry").unionByName(tree.select(F.col("parent").alias("entry"))).unionByName(tree.sparkSession.range(ROOT, ROOT + 1).select(F.col("id").cast(tree.schema["entry"].dataType).alias("entry"))).distinct()
    nodes = asked.join(tree, "entry", "left")
    # The root has no parent, so every ancestor list ends there, at a missing entry or before a repetition.
    up = nodes.select(F.col("entry").alias("id"), F.when(F.col("entry") != ROOT, F.col("parent")).alias("parent_id"))
    lines = ancestors(up).select("id", F.concat(F.array("id"), F.col("ancestors")).alias("line"))
    each = lines.select("id", F.size("line").alias("n"), F.element_at("line", -1).alias("last"), F.posexplode("line").alias("at", "entry")).where(F.col("entry") != ROOT)
    named = each.join(tree.select("entry", "name"), "entry", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("k"), "name"))).alias("parts"), F.first("last").alias("last"))
    names = F.filter(F.transform("parts", lambda p: p["name"]), lambda n: n.isNotNull())
    orphan = F.when(F.col("last") != ROOT, F.array(F.lit("."), F.lit("[ORPHAN]"))).otherwise(F.array(F.lit(".")))
    whole = named.select(F.col("id").alias("entry"), F.array_join(F.concat(orphan, names), "\\").alias("path"))
    return whole.unionByName(asked.where(F.col("entry") == ROOT).select("entry", F.lit(".").alias("path")))


_SLOT = 1 << 20  # bytes of a journal, and so at most as many records, whose links one task looks up


def _linked(records: DataFrame) -> DataFrame:
    """records with parent_usn and parent_name: the directory record that names each record's parent.

    That is the latest one of the parent's entry and sequence at or before the record, else the first one after it.
    Most folders have one directory record or none, so a join is enough, however many records name the folder; those
    with several take the latest one from values that are carried over slots of the journal.
    """
    found = F.struct(F.col("usn").alias("u"), F.col("name").alias("n"))
    dirs = records.where("is_dir").select(F.col("entry").alias("__k"), F.col("seq").alias("__s"), "usn", found.alias("__found"))
    per = dirs.groupBy("__k", "__s").agg(F.min_by("__found", "usn").alias("__first"), F.count(F.lit(1)).alias("__n"))
    named = records.join(per, (F.col("parent_entry") == F.col("__k")) & (F.col("parent_seq") == F.col("__s")), "left")
    several = named.where("__n > 1").withColumn("__kind", F.lit(1))
    changes = dirs.join(per.where("__n > 1").select("__k", "__s"), ["__k", "__s"]).withColumn("__kind", F.lit(0))
    both = several.unionByName(changes, allowMissingColumns=True)
    latest = carried(both, ["__k", "__s"], ["usn", "__kind"], "usn", {"__latest": F.col("__found")}, slot=F.floor(F.col("usn") / _SLOT)).where("__kind = 1")
    shown = lambda df, link: df.select(*records.columns, link["u"].alias("parent_usn"), link["n"].alias("parent_name"))
    return shown(named.where("__n IS NULL OR __n = 1"), F.col("__first")).unionByName(shown(latest, F.coalesce("__latest", "__first")))


def journal_parents(records: DataFrame) -> DataFrame:
    """records with parent_name: the name of each record's folder as the journal has it.

    records: (usn, entry, seq, parent_entry, parent_seq, name, is_dir). Reallocated entries have another sequence, so a
    deleted folder still resolves; joins and values carried in order replace the walk through the journal in reverse order.
    """
    return _linked(records).drop("parent_usn")


def saved_paths(records: DataFrame, mft: DataFrame | None = None) -> DataFrame:
    """records with parent_path, the whole path of each record's folder, and what it is made of: `names`, the folders that the
    journal's directory records give, and `above`, the entry over the first of them.

    Where the journal's folders end below the root, the path of the folder that is left is taken from mft, the file
    table's (entry, parent, name), if there is one; else it is `.\\[ORPHAN]`. The chain of folders comes from pointer doubling.
    """
    linked = materialize(_linked(records), "linked")
    dirs = linked.where("is_dir").select("usn", "parent_usn", "parent_entry", "name")
    lines = ancestors(dirs.select(F.col("usn").alias("id"), F.when(F.col("parent_usn") != F.col("usn"), F.col("parent_usn")).alias("parent_id")))
    lines = lines.select(F.col("id").alias("dir_usn"), F.concat(F.array("id"), F.col("ancestors")).alias("line"))
    each = lines.select("dir_usn", F.element_at("line", -1).alias("top_usn"), F.posexplode("line").alias("at", "usn")).join(dirs.select("usn", "name"), "usn")
    named = each.groupBy("dir_usn").agg(F.first("top_usn").alias("top_usn"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("k"), "name"))), lambda p: p["name"]).alias("names"))
    folders = named.join(dirs.select(F.col("usn").alias("top_usn"), F.col("parent_entry").alias("above")), "top_usn").select("dir_usn", "names", "above")
    out = linked.join(folders, linked["parent_usn"] == folders["dir_usn"], "left").withColumn("above", F.coalesce("above", "parent_entry"))
    if mft is not None:
        paths = parent_paths(mft).select(F.col("entry").alias("above"), F.col("path").alias("table_path"))
        out = out.join(paths, "above", "left")
    else:
        out = out.withColumn("table_path", F.lit(None).cast("string"))
    return out.withColumn("parent_path", _folder_path()).select(*records.columns, "parent_path", "names", "above")


def _folder_path() -> Column:
    start = F.when(F.col("above") == ROOT, F.lit(".")).otherwise(F.coalesce("table_path", F.lit(".\\[ORPHAN]")))
    return F.array_join(F.concat(F.array(start), F.coalesce("names", F.array().cast("array<string>"))), "\\")


def journal_paths(records: DataFrame, mft: DataFrame | None = None) -> DataFrame:
    """records with parent_path; see saved_paths()."""
    return saved_paths(records, mft).select(*records.columns, "parent_path")


def path_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(entry, path) of the folders whose path a newer file table gives anew or otherwise, or no longer (null)."""
    new = parent_paths(after).select("entry", "path")
    if before is None:
        return new.where(F.col("entry") != ROOT)
    old = parent_paths(before).select(F.col("entry").alias("old_entry"), F.col("path").alias("old_path"))
    both = new.join(old, new["entry"] == old["old_entry"], "full")
    return both.where(~F.col("path").eqNullSafe(F.col("old_path"))).select(F.coalesce("entry", "old_entry").alias("entry"), "path")


def refresh_paths(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """Saved paths (saved_paths()) after a change of the file table: only rows under its changed folders are made again.

    The journal's own folders are not resolved again; a longer journal is a new run of saved_paths().
    """
    moved = changes.select(F.col("entry").alias("above"), F.col("path").alias("table_path"))
    touched = saved.join(moved, "above").where(F.col("above") != ROOT).withColumn("parent_path", _folder_path())
    kept = saved.join(moved.where(F.col("above") != ROOT).select("above"), "above", "left_anti")
    return kept.select(*saved.columns).unionByName(touched.select(*saved.columns))


TIMES = ("created", "modified", "changed", "accessed")
SAFE_PATHS = r"(?i)^\.?\\?(windows\\(winsxs|servicing|assembly|installer|softwaredistribution)|program files( \(x86\))?\\(windowsapps|common files))(\\|$)"


def timestomping(mft: DataFrame) -> DataFrame:
    """Entries whose $SI times look set against their $FN times, with flags and a severity.

    mft: (name, ticks si_K and fn_K for those of TIMES that there are, and path if it is known). si_before_fn: some $SI time
    lies before its $FN time; zero_subsecond: some $SI time has no fraction of a second; copied: created after modified,
    which copying does too, so callers may set those findings apart; suppressed: in a folder of SAFE_PATHS. severity: by
    the largest difference (over a day, over an hour), one step higher for executables.
    """
    pairs = [(F.col(f"si_{k}"), F.col(f"fn_{k}")) for k in TIMES if f"si_{k}" in mft.columns and f"fn_{k}" in mft.columns]
    either = lambda each: F.coalesce(functools.reduce(lambda a, b: a | b, each), F.lit(False))
    behind, zero = either([F.coalesce(si < fn, F.lit(False)) for si, fn in pairs]), either([F.coalesce(zero_subsecond(si), F.lit(False)) for si, _ in pairs])
    delta = F.greatest(F.lit(0), *[fn - si for si, fn in pairs]) / 1e7
    step = F.when(delta > 86_400, 3).when(delta > 3_600, 2).otherwise(1) + F.when(F.lower(extension(F.col("name"))).isin(*EXECUTABLE), 1).otherwise(0)
    severity = F.when(step >= 4, "critical").when(step == 3, "high").when(step == 2, "medium").otherwise("low")
    copied = F.coalesce(F.col("si_created") > F.col("si_modified"), F.lit(False))
    safe = F.coalesce(F.col("path").rlike(SAFE_PATHS), F.lit(False)) if "path" in mft.columns else F.lit(False)
    flags = {"si_before_fn": behind, "zero_subsecond": zero, "copied": copied, "delta_seconds": delta, "severity": severity, "suppressed": safe}
    return mft.withColumns(flags).where("si_before_fn OR zero_subsecond")


def timestomp_summary(findings: DataFrame) -> DataFrame:
    """One row: raw $SI-before-$FN findings, suppressed ones, copied ones, and the confirmed rest."""
    return findings.agg(
        F.count_if("si_before_fn").alias("raw"), F.count_if("suppressed").alias("suppressed"), F.count_if(F.col("copied") & ~F.col("suppressed")).alias("copied"),
        F.count_if(~F.col("copied") & ~F.col("suppressed")).alias("confirmed"),
    )


def streams(mft: DataFrame) -> DataFrame:
    """Zone records of (entry, zone_contents): zone, referrer and host URL."""
    part = lambda name: F.regexp_extract("zone_contents", rf"(?i){name}=([^\r\n]*)", 1)
    return mft.where("zone_contents <> ''").select("entry", part("ZoneId").try_cast("int").alias("zone"), part("ReferrerUrl").alias("referrer"), part("HostUrl").alias("host_url"))


KNOWN_STREAMS = r"(?i)^(zone\.identifier|smartscreen|favicon|encryptable|\{[0-9a-f-]{36}\}|oecustomproperty|wofcompresseddata|com\.dropbox\.attributes|ms-properties|\u0005.*)$"


def stream_findings(streams: DataFrame) -> DataFrame:
    """streams (stream, perhaps content) with kind: zone, executable (by its name or its first bytes), suspicious or known."""
    name, zone = F.coalesce("stream", F.lit("")), F.lower(F.coalesce("stream", F.lit(""))) == "zone.identifier"
    code = F.lower(extension(name)).isin(*EXECUTABLE)
    if "content" in streams.columns:
        code = code | F.coalesce(F.substring(F.col("content").cast("binary"), 1, 2) == F.lit(b"MZ"), F.lit(False))
    return streams.withColumn("kind", F.when(zone, "zone").when(code, "executable").when(name.rlike(KNOWN_STREAMS), "known").otherwise("suspicious"))


def extension_scan(files: DataFrame) -> DataFrame:
    """(extension, n, entropy): counts with the Shannon entropy of the extension, highest first."""
    found = files.select(F.lower(extension(F.col("name"))).alias("extension")).where("extension <> ''").groupBy("extension").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("entropy", F.round(entropy(F.col("extension")), 6))


def ransomware(files: DataFrame, encrypted_ext: str, note: str, note_mode: str = "contains") -> DataFrame:
    """One row: encrypted files, bytes, first and last time, files a minute, and notes. files: (name, size, ts)."""
    low, want = F.lower("name"), note.lower()
    is_note = {"contains": low.contains(want), "exact": low == want, "regex": F.col("name").rlike("(?i)" + note)}[note_mode]
    hit = low.endswith(encrypted_ext.lower())
    when = lambda c: F.when(hit, F.col(c))
    found = files.agg(F.count_if(hit).alias("files"), F.sum(when("size")).alias("bytes"), F.min(when("ts")).alias("first_ts"), F.max(when("ts")).alias("last_ts"), F.count_if(is_note).alias("notes"))
    minutes = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 6e7
    found = found.withColumn("duration_minutes", minutes)
    return found.withColumn("files_per_minute", F.when(minutes > 0, F.col("files") / minutes).otherwise(F.col("files").cast("double")))


def ransomware_folders(files: DataFrame, encrypted_ext: str, limit: int = 25) -> DataFrame:
    """(path, files) of the folders with most encrypted files. files: (name, path)."""
    hit = files.where(F.lower("name").endswith(encrypted_ext.lower()))
    return hit.groupBy("path").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "path").limit(limit)


def ransomware_journal(records: DataFrame, rollup: DataFrame, minutes: int = 5) -> DataFrame:
    """Rename, overwrite and delete records from minutes before to minutes after the encryption of a ransomware() row."""
    step = F.make_interval(mins=F.lit(minutes))
    span = rollup.select((F.col("first_ts") - step).alias("__lo"), (F.col("last_ts") + step).alias("__hi"))
    kinds = records.where(F.col("reasons").rlike("Rename|DataOverwrite|FileDelete"))
    return kinds.crossJoin(F.broadcast(span)).where(F.col("ts").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row


# Categories of journal records by reason names and paths.
JOURNAL = (
    ("renames", r"Rename(Old|New)Name", None), ("deletions", r"FileDelete", None), ("creations", r"FileCreate", None), ("exfiltration", r"FileCreate|DataExtend", r"(?i)\.(zip|7z|rar|tar|gz)$"), ("execution", r"FileCreate|DataExtend", r"(?i)\.(exe|dll|ps1|bat|cmd|vbs|js|scr|pf)$"), ("persistence", r".", r"(?i)\\(startup|tasks|start menu)\\"),
    ("suspicious paths", r".", r"(?i)\\(temp|tmp|appdata|downloads|public|perflogs)\\"), ("security changes", r"SecurityChange", None), ("data overwrite", r"DataOverwrite", None), ("stream changes", r"StreamChange|NamedData", None), ("close patterns", r"^(.*\|)?Close$", None),
)


def journal_categories(records: DataFrame) -> DataFrame:
    """A row per record and category it falls in. records: (reasons, path, ...)."""
    each = [F.when(F.col("reasons").rlike(r) & (F.lit(True) if p is None else F.col("path").rlike(p)), F.lit(name)) for name, r, p in JOURNAL]
    return records.withColumn("category", F.explode(F.filter(F.array(*each), lambda c: c.isNotNull())))


def file_chains(records: DataFrame) -> DataFrame:
    """(entry, seq, story): the names and reasons of each file in the order of the journal."""
    told = F.struct("usn", F.concat_ws(": ", "name", "reasons").alias("what"))
    return records.groupBy("entry", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["what"]), " > ").alias("story"))


def directory_incidents(records: DataFrame, minutes: int = 5, at_least: int = 10) -> DataFrame:
    """Folders with at least so many records in a time slot. records: (parent_path, ts)."""
    slot = F.window("ts", f"{minutes} minutes")["start"]
    return records.groupBy("parent_path", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def near(records: DataFrame, ts_col: str, first: Column, last: Column, minutes: int = 5) -> DataFrame:
    """Records from minutes before the first to minutes after the last instant."""
    step = F.make_interval(mins=F.lit(minutes))
    return records.where(F.col(ts_col).between(first - step, last + step))


# Weight of each category of journal records in a finding's score.
WEIGHTS = {"persistence": 5, "exfiltration": 4, "execution": 4, "suspicious paths": 3, "security changes": 3, "stream changes": 3, "deletions": 2, "data overwrite": 2, "renames": 2, "creations": 1, "close patterns": 0}


def journal_findings(categorised: DataFrame) -> DataFrame:
    """(category, n, folders, first_ts, last_ts, top_folder, score, rank), the best score first.

    categorised: rows of journal_categories with (parent_path, ts, category). Records are counted per folder before they
    are counted per category. score: the category's weight times log2(1 + n); ties go by name.
    """
    per = categorised.groupBy("category", "parent_path").agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    top = F.max_by(F.coalesce("parent_path", F.lit("")), F.struct("k", F.coalesce("parent_path", F.lit(""))))
    found = per.groupBy("category").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("folders"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), top.alias("top_folder"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("category")], F.lit(1))
    scored = found.withColumn("score", F.round(weight * F.log2(1 + F.col("n")), 3))
    # At most one row a category is left, so the window is over a dozen rows.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "category")))


def journal_narrative(findings: DataFrame) -> DataFrame:
    """One row (narrative): a sentence for each finding that scores above 0, in order of rank."""
    said = F.format_string("%d %s records in %d folders from %s to %s, most of them in %s.", "n", "category", "folders", F.col("first_ts").cast("string"), F.col("last_ts").cast("string"), F.when(F.col("top_folder") == "", "an unknown folder").otherwise(F.col("top_folder")))
    told = F.array_sort(F.collect_list(F.struct("rank", said.alias("said"))))
    return findings.where("score > 0").agg(F.array_join(F.transform(told, lambda x: x["said"]), " ").alias("narrative"))
