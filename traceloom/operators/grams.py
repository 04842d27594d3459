"""Which texts hold which of many needles, as a join on grams: no automaton, no list of needles on the driver.

Every needle has one anchor, the gram of `size` characters in it with the fewest letters (needles that are shorter are
their own anchor); needles of LONG characters have one of that size, since short grams of words stand in most texts. Texts are cut into their distinct grams of those sizes, joined with the anchors, and what meets is
verified by `contains`. The number of needles is that of rows of a table, which Spark broadcasts or shuffles by its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LONG = 6


def grams_of(text: Column, size: int) -> Column:
    """All grams of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def anchored(needles: DataFrame, name: str, size: int = 4) -> DataFrame:
    """needles with __size and __gram, their anchor."""
    plain = lambda g: F.length(F.regexp_replace(g, r"[^\p{L} ]", ""))
    best = F.array_min(F.transform(grams_of(F.col(name), size), lambda g: F.struct(plain(g).alias("letters"), F.xxhash64(g).alias("h"), g.alias("gram"))))["gram"]
    return needles.where(F.length(name) > 0).withColumn("__size", F.least(F.length(name), F.lit(size))).withColumn("__gram", F.when(F.col("__size") < size, F.col(name)).otherwise(best))


def containing(texts: DataFrame, text: str, needles: DataFrame, name: str, size: int = 4) -> DataFrame:
    """Rows of texts with each needle (columns of both) that stands in their text, as it is written."""
    ready = anchored(needles.where(F.length(name) < LONG), name, size).unionByName(anchored(needles.where(F.length(name) >= LONG), name, max(size, LONG)))
    sizes = sorted(r["__size"] for r in ready.select("__size").distinct().collect())  # size + 1 numbers at most
    parts = []
    for s in sizes:
        cut = texts.withColumn("__gram", F.explode(F.array_distinct(grams_of(F.col(text), s))))
        met = cut.join(ready.where(F.col("__size") == s).drop("__size"), "__gram")
        parts.append(met.where(F.col(text).contains(F.col(name))).drop("__gram"))
    if not parts:
        empty = needles.limit(0).withColumn("__gram", F.lit(""))
        return texts.withColumn("__gram", F.lit("")).join(empty, "__gram").drop("__gram")
    return reduce(DataFrame.unionByName, parts)
