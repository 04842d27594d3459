"""Bookmarks, tags and merging of timelines: side tables and unions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import col


def add_tags(tags: DataFrame, more: DataFrame) -> DataFrame:
    """Union of (rowid, tag) tables; a pair is there once."""
    return tags.select("rowid", "tag").unionByName(more.select("rowid", "tag")).dropDuplicates(["rowid", "tag"])


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["rowid", "tag"], "left_anti")


def set_bookmarks(bookmarks: DataFrame, ids: DataFrame, add: bool = True) -> DataFrame:
    return bookmarks.select("rowid").unionByName(ids.select("rowid")).distinct() if add else bookmarks.join(ids, "rowid", "left_anti")


def toggle_bookmarks(bookmarks: DataFrame, ids: DataFrame) -> DataFrame:
    return set_bookmarks(bookmarks, ids, False).unionByName(ids.join(bookmarks, "rowid", "left_anti"))


def tag_filtered(df: DataFrame, predicate: Column, tag: str, id_col: str = "_rowid") -> DataFrame:
    return df.where(predicate).select(col(id_col).alias("rowid"), F.lit(tag).alias("tag"))


def with_tags(df: DataFrame, tags: DataFrame, id_col: str = "_rowid") -> DataFrame:
    """df with __tags__, the sorted array of each row's tags."""
    sets = tags.groupBy("rowid").agg(F.array_sort(F.collect_set("tag")).alias("__tags__"))
    return df.join(sets, df[id_col] == sets["rowid"], "left").drop("rowid").withColumn("__tags__", F.coalesce("__tags__", F.array().cast("array<string>")))


def having_tag(df: DataFrame, tags: DataFrame, wanted: list[str], id_col: str = "_rowid") -> DataFrame:
    ids = tags.where(F.col("tag").isin(wanted)).select(F.col("rowid").alias(id_col)).distinct()
    return df.join(ids, id_col, "left_semi")


def tag_summary(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def merge_timelines(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of timelines by column name, with _Source and datetime (each one's own time column); absent columns are ''."""
    parts = [df.select("*", F.lit(name).alias("_Source"), col(ts).alias("datetime")) for name, (df, ts) in sources.items()]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    texts = [c for c, t in both.dtypes if t == "string"]
    return both.fillna("", texts)


PROFILE_FIELDS = ("process", "parent", "host", "user", "image_path", "command_contains")


def profile_flag(findings: DataFrame, rules: DataFrame, flag: str, image: str = "image", parent: str = "parent_image", host: str = "host", user: str = "user", command: str = "command") -> DataFrame:
    """findings with `flag`: whether some rule of a profile matches, by all fields that it fills, in any case; the command by a
    part of it. rules: a table of some of PROFILE_FIELDS; other columns, as a rule's reason, are not compared, and a rule
    without fields matches nothing.

    Rules are grouped by the set of fields they fill (at most 63 sets). A set is one join on its fields; the parts of
    commands of rules with equal fields are one list, and those of rules with nothing else meet the distinct commands by
    grams. So rules stay a table, however many there are.
    """
    from .grams import containing
    from .process import base_name

    given = [c for c in PROFILE_FIELDS if c in rules.columns]
    low = lambda c: F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    field = {"process": lambda: base_name(col(image)), "parent": lambda: base_name(col(parent)), "host": lambda: low(host), "user": lambda: low(user), "image_path": lambda: low(image), "command_contains": lambda: low(command)}
    filled = rules.select(*[F.nullif(F.lower(F.col(c).cast("string")), F.lit("")).alias(c) for c in given]).distinct()
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(0) for k, c in enumerate(given)]
    filled = filled.withColumn("mask", functools.reduce(lambda a, b: a + b, bits, F.lit(0))).where("mask > 0")
    out, hits = findings, []
    for k, mask in enumerate(sorted(r["mask"] for r in filled.select("mask").distinct().collect())):
        names = [c for i, c in enumerate(given) if mask >> i & 1]
        keys = [c for c in names if c != "command_contains"]
        own, hit = filled.where(F.col("mask") == mask), f"__hit{k}"
        if not keys:
            commands = findings.select(low(command).alias("__command")).distinct()
            found = containing(commands, "__command", own.select("command_contains"), "command_contains").select("__command").distinct()
            out = out.withColumn("__command", low(command)).join(found.withColumn(hit, F.lit(True)), "__command", "left").drop("__command")
        else:
            parts = [F.collect_set("command_contains").alias(f"__parts{k}")] if len(keys) < len(names) else [F.lit(True).alias(hit)]
            lists = own.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(*parts)
            out = out.withColumns({f"__{c}": field[c]() for c in keys}).join(lists, [f"__{c}" for c in keys], "left").drop(*[f"__{c}" for c in keys])
            if len(keys) < len(names):
                out = out.withColumn(hit, F.exists(F.col(f"__parts{k}"), lambda x: low(command).contains(x))).drop(f"__parts{k}")
        hits.append(F.coalesce(F.col(hit), F.lit(False)))
    return out.select(*[col(c) for c in findings.columns if c != flag], functools.reduce(lambda a, b: a | b, hits, F.lit(False)).alias(flag))


def suppress(findings: DataFrame, rules: DataFrame, **columns: str) -> DataFrame:
    """Findings that no rule of a profile matches."""
    return profile_flag(findings, rules, "__known", **columns).where("NOT __known").drop("__known")


def with_profile(findings: DataFrame, suppressions: DataFrame, baselines: DataFrame, **columns: str) -> DataFrame:
    """findings with `suppressed` and `expected`: matched by a suppression, and by a baseline (which hides nothing)."""
    return profile_flag(profile_flag(findings, suppressions, "suppressed", **columns), baselines, "expected", **columns)


def merged_rules(saved: DataFrame, loaded: DataFrame) -> DataFrame:
    """A loaded profile's rules added to those there are, each once; missing fields are empty."""
    return saved.unionByName(loaded, allowMissingColumns=True).distinct()


def having_tag_like(df: DataFrame, tags: DataFrame, part: str, id_col: str = "_rowid") -> DataFrame:
    """Rows with a tag that holds a text, in any case."""
    ids = tags.where(F.lower("tag").contains(part.lower())).select(F.col("rowid").alias(id_col)).distinct()
    return df.join(ids, id_col, "left_semi")


AUTO_TAGS = {"timestomped": "Timestomp Indicator", "downloaded": "Downloaded", "encrypted": "Encrypted", "notes": "Ransom Note", "payload": "Payload", "modified_burst": "Modified Burst", "created_burst": "Created Burst"}


def auto_tags(iocs: DataFrame | None = None, verdicts: DataFrame | None = None, **found: DataFrame) -> DataFrame:
    """(rowid, tag) of analysis results: tables (rowid) by the names in AUTO_TAGS, iocs (rowid, ioc), verdicts (rowid, verdict)."""
    parts = [df.select("rowid", F.lit(AUTO_TAGS[name]).alias("tag")) for name, df in found.items()]
    if iocs is not None:
        parts.append(iocs.select("rowid", F.concat(F.lit("IOC: "), F.col("ioc")).alias("tag")))
    if verdicts is not None:
        named = verdicts.where(F.col("verdict").isin("malicious", "suspicious", "clean"))
        parts.append(named.select("rowid", F.concat(F.lit("VT: "), F.initcap("verdict")).alias("tag")))
    return functools.reduce(DataFrame.unionByName, parts).distinct()
