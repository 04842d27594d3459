"""What the training-data operators share: tables, block counts and small expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_at_exit, drop_between, drop_table, materialize, new_path, tables_made  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(column: Column) -> Column:
    """Bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def blocks_of(df: DataFrame, column: str, block_bytes: int) -> int:
    """Number of blocks of about block_bytes that the texts of a column fill."""
    total = df.agg(F.sum(utf8_bytes(F.col(column)) + 64)).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as text; of the empty text for null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def matched(rows: DataFrame, per_key: DataFrame, keys: list[str], n_col: str, hot_share: int = 1000, most: int | None = None) -> DataFrame:
    """rows joined (inner) with per_key, a written table of one row a key, on keys; n_col is not returned.

    n_col: how many of the rows a key has, about. Keys with more than one of hot_share of all rows are fewer than hot_share
    (most, if given, is the number of the largest that count, where their rows are wide): they are broadcast and their
    rows stay where they are. The other keys are joined by a shuffle, at every size alike.
    """
    total = per_key.agg(F.sum(n_col)).first()[0] or 0
    large = per_key.where(F.col(n_col) > F.lit(total / min(hot_share, most or hot_share)))
    hot, rest = F.broadcast(large.drop(n_col)), per_key.where(F.col(n_col) <= F.lit(total / min(hot_share, most or hot_share))).drop(n_col)
    cold = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(hot, keys).unionByName(cold)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of every node in a link (a, b) but the roots: root is the smallest node reachable. Rounds of large
    and small stars.

    A round costs two shuffles of the links and its result is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Nodes with very many links are matched with their minima where they are.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = materialize(matched(both, low, ["u"], "n").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = matched(large, least, ["u"], "n").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        after = materialize(small, "links")
        sums = [e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, after)]
        for done in (edges, low, large, least):
            drop_table(done)
        edges = after
        if tuple(sums[0]) == tuple(sums[1]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def sliced_counts(total: np.ndarray, slices: int = 16, tasks_at_once: int = 256) -> list[pa.Array]:
    """A task's counts as columns (slice, level, counts), one row a slice, for added_counts()."""
    from pyspark import TaskContext

    level = TaskContext.get().partitionId() // tasks_at_once
    return [pa.array(range(slices), pa.int32()), pa.array([level] * slices, pa.int64()), pa.array([p.tobytes() for p in np.array_split(total, slices)], pa.binary())]


def added_counts(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counts; a slice is added over tasks_at_once tasks, then over those sums. rows: a written table."""
    schema = "slice int, level long, counts binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame([(int(pdf["slice"].iloc[0]), int(pdf["level"].iloc[0]), total.tobytes())], columns=["slice", "level", "counts"])

    some = rows.groupBy("slice", "level").applyInPandas(add, schema)
    found = some.withColumn("level", F.lit(0).cast("long")).groupBy("slice").applyInPandas(add, schema).orderBy("slice").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found]) if found else np.zeros(size, np.int64)


def summed_counts(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of df of the `size` counts that count(batch) gives; of fixed size, whatever the input."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(sliced_counts(sum(map(count, batches), np.zeros(size, np.int64))), ["slice", "level", "counts"])

    return added_counts(df.mapInArrow(each, "slice int, level long, counts binary"), size)
