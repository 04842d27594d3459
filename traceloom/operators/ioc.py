"""Indicator matching, counts, tags and verdict enrichment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify_ioc, defang, verdict, verdict_key
from .filters import text_of
from .grams import containing

AT_ONCE = 50_000  # indicators in an automaton, at most


def prepare(iocs: DataFrame, name: str = "ioc") -> DataFrame:
    """(ioc, category): defanged, without comments and empty lines, one of each spelling in any case."""
    rows = iocs.select(F.trim(F.col(name)).alias("raw")).where("raw <> '' AND NOT startswith(raw, '#')").select(defang(F.col("raw")).alias("ioc"))
    kept = rows.where("ioc <> ''").groupBy(F.lower("ioc").alias("k")).agg(F.min("ioc").alias("ioc"))
    return kept.select("ioc", classify_ioc(F.col("ioc")).alias("category"))


def _blob(columns: Sequence[str]) -> Column:
    return F.concat_ws("\x01", *[text_of(c) for c in columns])


def match(df: DataFrame, iocs: DataFrame, columns: Sequence[str], id_col: str, at_once: int = AT_ONCE) -> DataFrame:
    """(ioc, row) of each indicator that stands, in any case, somewhere in a row's columns.

    Up to `at_once` indicators make an automaton (Aho and Corasick 1975) that a row's texts go through once. More of them
    stay a table and meet the rows by grams (see grams.py), in one pass as well; then the driver holds none of them.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("row"), F.lower(_blob(columns)).alias("blob"))
    named = iocs.select("ioc", F.lower("ioc").alias("low")).where("low <> ''").distinct()
    part = [(r["ioc"], r["low"]) for r in named.limit(at_once + 1).collect()]
    if len(part) > at_once:
        return containing(rows, "blob", named, "low").select("ioc", "row")

    def scanned(names: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for name, low in names:
                machine.add_word(low, [*machine.get(low, []), name])
            machine.make_automaton()
            for batch in batches:
                found, at = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    hits = {name for _, same in machine.iter(text) for name in same}
                    found.extend(hits)
                    at.extend([k] * len(hits))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=["ioc", "row"])

        return rows.mapInArrow(run, f"ioc string, row {kind}")

    return scanned(part) if part else df.sparkSession.createDataFrame([], f"ioc string, row {kind}")


def match_patterns(df: DataFrame, patterns: Sequence[str], columns: Sequence[str], id_col: str, batch: int = 200) -> DataFrame:
    """(ioc, row) of each regular expression that fits, in any case, somewhere in a row's columns, in one pass.

    Patterns are tried one by one only where the alternation of their batch fits.
    """
    blob, each = F.col("blob"), []
    for at in range(0, len(patterns), batch):
        some = patterns[at : at + batch]
        one = F.array_compact(F.array(*[F.when(blob.rlike("(?i)" + p), F.lit(p)) for p in some]))
        each.append(F.when(blob.rlike("(?i)" + "|".join(f"(?:{p})" for p in some)), one).otherwise(F.array().cast("array<string>")))
    found = F.flatten(F.array(*each)) if each else F.array().cast("array<string>")
    return df.select(F.col(id_col).alias("row"), _blob(columns).alias("blob")).select(F.explode(found).alias("ioc"), "row")


def row_map(hits: DataFrame) -> DataFrame:
    """(row, iocs) of every row with a hit: its indicators, sorted."""
    return hits.groupBy("row").agg(F.array_sort(F.collect_set("ioc")).alias("iocs"))


def hit_counts(iocs: DataFrame, hits: DataFrame) -> DataFrame:
    """(ioc, hits) of every indicator, 0 where it was not found."""
    counts = hits.groupBy("ioc").agg(F.count_distinct("row").alias("hits"))
    return iocs.join(counts, "ioc", "left").select("ioc", F.coalesce("hits", F.lit(0)).alias("hits"))


def hit_tags(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("row").alias("rowid"), F.concat(F.lit("IOC: "), F.col("ioc")).alias("tag"))


def enrich(iocs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ioc, verdict, score) from a table (key, malicious, suspicious, total); malicious first."""
    keyed = iocs.withColumn("key", verdict_key(F.col("ioc"))).join(verdicts, "key", "left")
    total = F.coalesce("total", F.lit(0))
    score = F.when(total > 0, (F.coalesce("malicious", F.lit(0)) + F.coalesce("suspicious", F.lit(0))) / total).otherwise(0.0)
    named = verdict(F.coalesce("malicious", F.lit(0)), F.coalesce("suspicious", F.lit(0)), total)
    rank = F.when(named == "malicious", 0).when(named == "suspicious", 1).when(named == "clean", 2).otherwise(3)
    return keyed.select("ioc", named.alias("verdict"), score.alias("score"), rank.alias("rank")).orderBy("rank", "ioc").drop("rank")
