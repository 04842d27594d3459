"""Stacking, statistics, histograms and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import col, text_of

STACK_LIMIT = 10_000


def _stacks(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(text_of(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def stack_values(df: DataFrame, name: str, limit: int = STACK_LIMIT, by: str = "n") -> DataFrame:
    """(value, n, share, rare) of the most frequent values (by = "n") or the first ones (by = "value").

    Shares are of all rows: the sum over the groups is one row, and the groups are dealt once for both.
    """
    groups = _stacks(df, name)
    total = groups.agg(F.sum("n").cast("double").alias("total"))
    shared = groups.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))
    order = [F.desc("n"), F.col("value")] if by == "n" else [F.col("value")]
    return shared.withColumn("rare", F.col("share") < 0.01).orderBy(*order).limit(limit)


def stack_summary(df: DataFrame, name: str, limit: int = STACK_LIMIT) -> DataFrame:
    """One row: the number of values and of rows, and whether stack_values() leaves values out."""
    found = _stacks(df, name).agg(F.count(F.lit(1)).alias("unique_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return found.withColumn("truncated", F.col("unique_values") > limit)


def unique_values(df: DataFrame, name: str, contains: str = "", limit: int = 25) -> DataFrame:
    rows = df.where(F.lower(text_of(name)).contains(contains.lower())) if contains else df
    return rows.groupBy(text_of(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def group_levels(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts of every level of a grouping hierarchy in one pass."""
    return df.rollup(*[col(c) for c in levels]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def column_stats(df: DataFrame, name: str) -> DataFrame:
    x, number = text_of(name), col(name).try_cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x != "").alias("non_empty"), (F.count_if(x != "").cast("double") / F.count(F.lit(1)).cast("double")).alias("fill_rate"), F.count_distinct(F.when(x != "", x)).alias("distinct_values"),
        F.min(F.when(x != "", col(name))).alias("min_value"), F.max(F.when(x != "", col(name))).alias("max_value"), F.avg(number).alias("mean_value"),
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10, tracked: int = 1024, parts: int = 10) -> DataFrame:
    """One row a column, from one scan of all of them by summaries that merge: (column, n, non_empty, fill_rate,
    distinct_estimate, numbers, min_value, max_value, mean_value, deviation, bounds, from_ts, to_ts, span_seconds, top,
    top_exact).

    top: the most frequent non-empty values as (item, count), from a sketch of frequent items that holds `tracked` of them:
    counts are exact where top_exact says so (then the sketch has held every value), else estimates. bounds: values that cut
    a column's numbers into `parts` parts of equal size. Times have a span instead of a mean.
    """
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")]
    share = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    for k, c in enumerate(names):
        x = text_of(c)
        value = F.when(x != "", x)
        timed = kinds[c] in ("timestamp", "timestamp_ntz", "date")
        number = F.lit(None).cast("double") if timed else col(c).try_cast("double")
        number = F.when(F.isnan(number), None).otherwise(number)
        stamp = col(c).cast("timestamp") if timed else F.lit(None).cast("timestamp")
        each = {
            "filled": F.count(value), "distinct": F.approx_count_distinct(value), "numbers": F.count(number), "low": F.min(value), "high": F.max(value), "mean": F.avg(number), "deviation": F.stddev_samp(number),
            "bounds": F.percentile_approx(number, share, 10_000), "least": F.min(number), "most": F.max(number), "from": F.min(stamp), "to": F.max(stamp), "top": F.call_function("approx_top_k", value, F.lit(tracked * 3 // 4), F.lit(tracked)),
        }
        aggs += [v.alias(f"{name}{k}") for name, v in each.items()]

    def row(k: int, c: str):
        at = lambda name: F.col(f"{name}{k}")
        # A column of numbers only has numeric bounds.
        numeric = (at("numbers") > 0) & (at("numbers") == at("filled"))
        items = F.filter(at("top"), lambda x: x["item"].isNotNull())
        held = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["count"])
        order = F.array_sort(F.transform(items, lambda x: F.struct((-x["count"]).alias("k"), x["item"].alias("item"))))
        best = F.transform(F.slice(order, 1, top), lambda x: F.struct(x["item"].alias("item"), (-x["k"]).alias("count")))
        shown = lambda number, text: F.when(numeric, at(number).cast("string")).otherwise(at(text))
        span = (F.unix_micros(at("to")) - F.unix_micros(at("from"))) / 1e6
        return F.struct(
            F.lit(c).alias("column"), F.col("n"), at("filled").alias("non_empty"), (at("filled") / F.col("n")).alias("fill_rate"), at("distinct").alias("distinct_estimate"), at("numbers").alias("numbers"), shown("least", "low").alias("min_value"), shown("most", "high").alias("max_value"),
            at("mean").alias("mean_value"), at("deviation").alias("deviation"), at("bounds").alias("bounds"), at("from").alias("from_ts"), at("to").alias("to_ts"), span.alias("span_seconds"), best.alias("top"), (held == at("filled")).alias("top_exact"),
        )

    return df.agg(*aggs).select(F.explode(F.array(*[row(k, c) for k, c in enumerate(names)])).alias("x")).select("x.*")


def empty_columns(df: DataFrame) -> DataFrame:
    """(column) of the columns without a value, in one scan."""
    found = df.agg(*[F.coalesce(F.max(F.trim(text_of(c)) != ""), F.lit(False)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("filled")) for k, c in enumerate(df.columns)])
    return found.select(F.explode(each).alias("x")).where("NOT x.filled").select("x.column")


def duplicates(df: DataFrame, name: str, limit: int | None = 100) -> DataFrame:
    found = df.groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.orderBy(F.desc("n"), "value").limit(limit) if limit else found


def only_duplicates(df: DataFrame, name: str) -> DataFrame:
    return df.join(duplicates(df, name, None).select(F.col("value").alias(name)), name, "left_semi")


def histogram(df: DataFrame, ts_col: str, grain: str = "day", source_col: str | None = None) -> DataFrame:
    keys = [F.date_trunc(grain, col(ts_col)).alias("bucket"), *([col(source_col).alias("source")] if source_col else [])]
    return df.where(col(ts_col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def source_coverage(df: DataFrame, source_col: str, ts_col: str) -> DataFrame:
    """Per source its first and last time, rows and span, beside the span of all sources."""
    each = df.where(col(ts_col).isNotNull()).groupBy(col(source_col).alias("source")).agg(F.min(col(ts_col)).alias("first_ts"), F.max(col(ts_col)).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    whole = each.agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"))
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    spans = each.withColumn("span_seconds", seconds(F.col("first_ts"), F.col("last_ts")))
    return spans.crossJoin(F.broadcast(whole)).withColumn("total_seconds", seconds(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def activity_heatmap(df: DataFrame, ts_col: str) -> DataFrame:
    """All 7 x 24 (day of week from 1 = Sunday, hour) cells with their counts, zeros included."""
    spark = df.sparkSession
    cells = spark.range(7 * 24).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    seen = df.where(col(ts_col).isNotNull()).groupBy(F.dayofweek(col(ts_col)).alias("dow"), F.hour(col(ts_col)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(seen, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def activity_series(df: DataFrame, times: dict[str, str], grain: str = "hour") -> DataFrame:
    """(kind, bucket, n): rows per hour or day by each of several times, as created and modified, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.date_trunc(grain, col(c)).alias("bucket")) for kind, c in times.items()]))
    return df.select(each.alias("x")).select("x.*").where("bucket IS NOT NULL").groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def edges(df: DataFrame, source: str, target: str, ts_col: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[col(c) for c in (source, target, *extra)]).agg(F.count(F.lit(1)).alias("n"), F.min(col(ts_col)).alias("first_ts"), F.max(col(ts_col)).alias("last_ts"))


def infer_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """(column, kind) of every column of texts in one scan: timestamp, numeric or text by the share of non-empty values."""
    import re

    from ..functions.timestamps import normalize_timestamp

    aggs, named = [], re.compile("time|date|created|modified|access", re.I)
    for k, c in enumerate(df.columns):
        x = text_of(c)
        shape = F.lit(True) if named.search(c) else ~x.rlike(r"^\d+(\.\d+)?$")
        aggs += [F.count_if(x != "").alias(f"n{k}"), F.count_if(normalize_timestamp(x).isNotNull() & shape).alias(f"t{k}"), F.count_if(x.try_cast("double").isNotNull()).alias(f"d{k}")]
    kind = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col(f"t{k}") >= share * F.col(f"n{k}")), "timestamp").when((F.col(f"n{k}") > 0) & (F.col(f"d{k}") >= share * F.col(f"n{k}")), "numeric").otherwise("text")
    each = F.array(*[F.struct(F.lit(c).alias("column"), kind(k).alias("kind")) for k, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.explode(each).alias("x")).select("x.*")
