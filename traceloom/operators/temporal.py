"""Gaps, bursts and windowed detections over time.

Sessions and bursts are computed on buckets that are aggregated first (at most 1440 a day), so the windows over all of
them see few rows however many events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .filters import col


def all_rows():
    """One window over all rows, for tables of buckets."""
    return Window.partitionBy(F.lit(1))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000).cast("double")


def minutes_of(df: DataFrame, ts_col: str) -> DataFrame:
    return df.where(col(ts_col).isNotNull()).groupBy(F.date_trunc("minute", col(ts_col)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def sessions(df: DataFrame, ts_col: str, threshold_minutes: int = 60) -> DataFrame:
    """(session, from_ts, to_ts, n, duration_minutes): runs of minutes without a silence over the threshold."""
    order = all_rows().orderBy("minute")
    silence = (seconds(F.col("minute")) - seconds(F.lag("minute").over(order))) / 60
    cut = minutes_of(df, ts_col).withColumn("cut", (F.coalesce(silence, F.lit(0.0)) > threshold_minutes).cast("int"))
    numbered = cut.withColumn("session", F.sum("cut").over(order) + 1)
    return numbered.groupBy("session").agg(F.min("minute").alias("from_ts"), F.max("minute").alias("to_ts"), F.sum("n").alias("n")).withColumn("duration_minutes", ((seconds(F.col("to_ts")) - seconds(F.col("from_ts"))) / 60).cast("long"))


def gaps(df: DataFrame, ts_col: str, threshold_minutes: int = 60) -> DataFrame:
    """(from_ts, to_ts, minutes) of the silences over the threshold."""
    order = all_rows().orderBy("minute")
    pairs = minutes_of(df, ts_col).select(F.lag("minute").over(order).alias("from_ts"), F.col("minute").alias("to_ts"))
    return pairs.withColumn("minutes", ((seconds(F.col("to_ts")) - seconds(F.col("from_ts"))) / 60).cast("long")).where(F.col("minutes") > threshold_minutes)


def burst_windows(df: DataFrame, ts_col: str, window_minutes: int = 5, multiplier: float = 5) -> DataFrame:
    """(window_start, n, baseline, is_burst) of every window with rows; baseline: their median, at least 1."""
    w = window_minutes * 60
    start = F.timestamp_seconds(F.floor(seconds(col(ts_col)) / w) * w)
    counts = df.where(col(ts_col).isNotNull()).groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("baseline", F.greatest(F.median("n").over(all_rows()), F.lit(1.0))).withColumn("is_burst", F.col("n") > multiplier * F.col("baseline"))


def bursts(df: DataFrame, ts_col: str, window_minutes: int = 5, multiplier: float = 5) -> DataFrame:
    """(from_ts, to_ts, n, factor, duration_minutes): adjacent burst windows merged."""
    w = window_minutes * 60
    flagged = burst_windows(df, ts_col, window_minutes, multiplier).where("is_burst")
    slot = F.floor(seconds(F.col("window_start")) / w)
    islands = flagged.withColumn("island", slot - F.row_number().over(all_rows().orderBy("window_start")))
    merged = islands.groupBy("island").agg(F.min("window_start").alias("from_ts"), F.timestamp_seconds(seconds(F.max("window_start")) + w).alias("to_ts"), F.sum("n").alias("n"), F.max("n").alias("peak"), F.first("baseline").alias("baseline"))
    return merged.select("from_ts", "to_ts", "n", (F.col("peak") / F.col("baseline")).alias("factor"), ((seconds(F.col("to_ts")) - seconds(F.col("from_ts"))) / 60).cast("long").alias("duration_minutes"))


def tag_ranges(df: DataFrame, ts_col: str, ranges: DataFrame, id_col: str, bucket_seconds: int = 3600) -> DataFrame:
    """(id, tag) of the rows inside ranges (from_ts, to_ts, tag): an equi-join on time buckets, then the exact test."""
    bucket = lambda c: F.floor(seconds(c) / bucket_seconds)
    spread = ranges.select("from_ts", "to_ts", "tag", F.explode(F.sequence(bucket(F.col("from_ts")), bucket(F.col("to_ts")))).alias("__bucket"))
    rows = df.select(col(id_col).alias(id_col), col(ts_col).alias("__ts"), bucket(col(ts_col)).alias("__bucket"))
    return rows.join(spread, "__bucket").where(F.col("__ts").between(F.col("from_ts"), F.col("to_ts"))).select(id_col, "tag").distinct()


DAY = 86_400


def _in_time(df: DataFrame, ts_col: str, window_seconds: int) -> DataFrame:
    """df dealt to slots of time (__slot), a day or the window long: a row is in its own slot and, if a window that begins
    in the next one can reach back to it, in that one too; __own tells them apart. Rows without a time are in no window.

    So a key with very many rows is worked on a slot at a time, by several tasks.
    """
    at, size = F.unix_micros(col(ts_col).cast("timestamp")), max(window_seconds, DAY) * 1_000_000
    slot = lambda x: F.floor(x / size)
    both = df.withColumn("__at", at).withColumn("__slot", F.explode(F.sequence(slot(F.col("__at")), slot(F.col("__at") + window_seconds * 1_000_000))))
    return both.withColumn("__own", F.col("__slot") == slot(F.col("__at")))


def _kept(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__at", "__slot", "__own")


def brute_force(failures: DataFrame, keys: list[str], ts_col: str, at_least: int = 5, window_seconds: int = 300) -> DataFrame:
    """Failures with at least so many of the same keys in the trailing window, both ends included; column n_window."""
    span = Window.partitionBy(*[col(k) for k in keys], "__slot").orderBy("__at").rangeBetween(-window_seconds * 1_000_000, 0)
    return _kept(_in_time(failures, ts_col, window_seconds).withColumn("n_window", F.count(F.lit(1)).over(span))).where(F.col("n_window") >= at_least)


def password_spray(failures: DataFrame, source: str, target: str, ts_col: str, at_least: int = 3, window_seconds: int = 1800) -> DataFrame:
    """Failures of a source against at least so many targets in the trailing window, both ends included; column n_targets.

    A failure counts its target from its time until the target's next failure takes over or the window has passed. Those
    spans open and close as +1 and -1 in the order of time, so one running sum a source counts them, however many
    failures a window holds.
    """
    timed = _in_time(failures, ts_col, window_seconds)
    following = F.lead("__at").over(Window.partitionBy(col(source), col(target), "__slot").orderBy("__at"))
    closes = F.least(2 * following, 2 * (F.col("__at") + window_seconds * 1_000_000) + 1)
    named = col(target).isNotNull().cast("int")
    marked = timed.withColumn("__moves", F.array(F.struct((2 * F.col("__at")).alias("at"), named.alias("step"), F.lit(True).alias("row")), F.struct(closes.alias("at"), (-named).alias("step"), F.lit(False).alias("row"))))
    moves = marked.select("*", F.explode("__moves").alias("__m")).drop("__moves")
    open_now = F.sum("__m.step").over(Window.partitionBy(col(source), "__slot").orderBy("__m.at").rangeBetween(Window.unboundedPreceding, 0))
    return _kept(moves.withColumn("n_targets", open_now.cast("int")).where(F.col("__m.row") & (F.col("n_targets") >= at_least)).drop("__m"))


def success_after_failure(df: DataFrame, keys: list[str], ts_col: str, failed: Column, succeeded: Column, within_seconds: int = 600) -> DataFrame:
    """Successes within so many seconds after a failure of the same keys; column fail_ts is the last failure's time."""
    before = Window.partitionBy(*[col(k) for k in keys], "__slot").orderBy(col(ts_col)).rowsBetween(Window.unboundedPreceding, -1)
    marked = _in_time(df, ts_col, within_seconds).withColumn("fail_ts", F.last(F.when(failed, col(ts_col)), ignorenulls=True).over(before))
    return _kept(marked).where(succeeded & (seconds(col(ts_col)) - seconds(F.col("fail_ts")) <= within_seconds))


def first_seen(df: DataFrame, source: str, target: str, ts_col: str, share: float = 0.01) -> DataFrame:
    """First rows of (source, target) pairs that lie in the first share of the timeline's span or are the source's first."""
    span = df.agg(F.min(col(ts_col)).alias("lo"), F.max(col(ts_col)).alias("hi"))
    pairs = df.groupBy(col(source).alias(source), col(target).alias(target)).agg(F.min(col(ts_col)).alias("first_ts")).crossJoin(F.broadcast(span))
    rank = F.row_number().over(Window.partitionBy(source).orderBy("first_ts", target))
    early = seconds(F.col("first_ts")) <= seconds(F.col("lo")) + share * (seconds(F.col("hi")) - seconds(F.col("lo")))
    return pairs.withColumn("rank_of_source", rank).where(early | (F.col("rank_of_source") == 1)).select(source, target, "first_ts", early.alias("early"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts_col: str, value: str, out: str) -> DataFrame:
    """left with the value of the latest earlier row of right with the same keys: a union and one window, no theta join."""
    a = left.withColumn("__kind", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*[col(k) for k in (*keys, ts_col)], col(value).alias("__value")).withColumn("__kind", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(ts_col), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last("__value", ignorenulls=True).over(before)).where("__kind = 1").drop("__kind", "__value")


def carried(df: DataFrame, keys: list[str], order: list[str], ts_col: str, last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, slot_seconds: int = 3600, slot: Column | None = None) -> DataFrame:
    """df with running values of each key, in order: `last`, the last non-null value before a row; `sums`, the sum up to it.

    A key with very many rows is several tasks: rows are dealt to slots of time, each slot leaves one row with its own last
    values and sums, those rows give every slot what it starts with, and windows run inside slots only. order starts with
    the time, or with what `slot`, a number that rises with the order, is made of. The rows are written once.
    """
    last, sums = last or {}, sums or {}
    slot = F.coalesce(F.floor(seconds(col(ts_col)) / slot_seconds) if slot is None else slot, F.lit(-(1 << 62)))
    kept = {f"__{n}": v for n, v in (last | sums).items()}
    rows = materialize(df.withColumns({"__slot": slot} | kept), "carried")
    place = F.struct(*[col(c) for c in order])
    ends = [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in last] + [F.sum(f"__{n}").alias(f"__{n}") for n in sums]
    per = rows.groupBy(*[col(k) for k in keys], "__slot").agg(*ends)
    earlier = Window.partitionBy(*[col(k) for k in keys]).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__from_{n}") for n in last] + [F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__from_{n}") for n in sums]
    given = per.select(*[col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__slot").alias("__at_slot"), *starts)
    same = F.col("__slot") == F.col("__at_slot")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(given[f"__key{i}"])
    inside = Window.partitionBy(*[col(k) for k in keys], "__slot").orderBy(*[col(c) for c in order])
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    values = {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(before), F.col(f"__from_{n}")) for n in last}
    values |= {n: F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)) + F.col(f"__from_{n}") for n in sums}
    return rows.join(given, same).select(*[col(c) for c in df.columns], *[v.alias(n) for n, v in values.items()])


def densest_window(df: DataFrame, ts_col: str, window_seconds: int = 180) -> DataFrame:
    """The instant from which the window holds most rows, on rows counted per second first.

    Windows run inside slots of a day, or of the window where it is longer; a slot sees the seconds of the next one that
    its windows reach, so each task's rows are bounded by a slot's seconds.
    """
    size = max(DAY, window_seconds)
    per = df.where(col(ts_col).isNotNull()).groupBy(F.floor(seconds(col(ts_col))).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    spread = per.withColumn("slot", F.explode(F.sequence(F.floor((F.col("s") - (window_seconds - 1)) / size), F.floor(F.col("s") / size))))
    ahead = F.sum("n").over(Window.partitionBy("slot").orderBy("s").rangeBetween(0, window_seconds - 1))
    own = spread.withColumn("total", ahead).where(F.col("slot") == F.floor(F.col("s") / size))
    return own.orderBy(F.desc("total"), "s").limit(1).select(F.timestamp_seconds("s").alias("from_ts"), "total")
