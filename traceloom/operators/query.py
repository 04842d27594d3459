"""Sorting, paging, projection, colours and row identity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .filters import Condition, col, search


def with_row_ids(df: DataFrame, order: Sequence[str], name: str = "_rowid") -> DataFrame:
    """Gapless ids from 0 in the given total order, without one task for all rows: a range sort, then partition offsets."""
    ranged = df.repartitionByRange(*[col(c) for c in order]).sortWithinPartitions(*[col(c) for c in order])
    rows = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = materialize(rows, "rows")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def typed_sort_key(name: str, kind: str) -> Column:
    """Sort key of a column: kind is timestamp, numeric or text."""
    from ..functions.timestamps import normalize_timestamp

    x = col(name)
    return {"timestamp": lambda: normalize_timestamp(x.cast("string")), "numeric": lambda: x.try_cast("double"), "text": lambda: F.lower(x)}[kind]()


def page(df: DataFrame, sort_key: Column, tiebreak: str, descending: bool = False, offset: int = 0, limit: int = 5000) -> DataFrame:
    key = sort_key.desc_nulls_last() if descending else sort_key.asc_nulls_first()
    return df.orderBy(key, col(tiebreak)).offset(offset).limit(limit)


@dataclass(frozen=True)
class ColorRule:
    column: str | None
    condition: str
    value: str
    color: str


def color_column(df: DataFrame, rules: Sequence[ColorRule]) -> Column:
    """Colour of the first rule that matches, null if none."""
    out = F.lit(None).cast("string")
    names = [c for c, t in df.dtypes if t == "string"]
    for rule in reversed(rules):
        if rule.column:
            hit = Condition(rule.column, rule.condition, rule.value).predicate()
        elif rule.condition in ("contains", "regex"):
            hit = search(names, rule.value, "like" if rule.condition == "contains" else "regex")
        else:
            hit = F.lit(False)
            for name in names:
                hit = hit | Condition(name, rule.condition, rule.value).predicate()
        out = F.when(hit, F.lit(rule.color)).otherwise(out)
    return out


def palette(df: DataFrame, name: str, colors: Sequence[str]) -> DataFrame:
    """A colour for each distinct value, in the order of the values."""
    numbered = with_row_ids(df.select(col(name).alias("value")).distinct(), ["value"], "k")
    return numbered.select("value", F.element_at(F.array(*map(F.lit, colors)), (F.col("k") % len(colors)).cast("int") + 1).alias("color"))


def rows_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "_rowid") -> DataFrame:
    return df.join(ids, id_col, "left_semi")


def invert_selection(df: DataFrame, ids: DataFrame, id_col: str = "_rowid") -> DataFrame:
    return df.join(ids, id_col, "left_anti")


def highlight_spans(text: Column, terms: Sequence[str]) -> Column:
    """Every occurrence of the terms, longest terms first."""
    pattern = "(?i)" + "|".join("\\Q" + t + "\\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
