"""Sharding by jump consistent hashing.

Method: a stable 64-bit key of the row (xxHash64 of its id) is placed by the jump hash of Lamping and Veach (2014):
no ring table, and when one shard is appended a row either stays or moves into the new shard.
Inside its shard a row gets a slot, gapless from 0, without sorting a shard in one task: rows are counted in
(shard, bucket) cells, the cells of a shard are put end to end, and a row's slot is its cell's start plus its place there.

Defined results: a null id is a key like any other (all such rows share a shard); a null or empty text has size 8 and
the crc of the empty text; repeated rows are counted first and get successive slots; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

_STEP = np.uint64(2862933555777941757)  # multiplier of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for shards >= 1."""
    key, at = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64)
    jump = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(active):
            at[active] = jump[active]
            key[active] = key[active] * _STEP + np.uint64(1)
            jump[active] = ((at[active] + 1) * (float(1 << 31) / ((key[active] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            active = active[jump[active] < shards]
    return at


def _placer(shards: int):
    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, buckets: int = 1024) -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard); grown_shard is the shard among one more.

    buckets: cells of a shard whose rows one task numbers; raise it with the input (rows / (shards * buckets) in a task).
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("\0null")))
    same = rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = same.withColumn("key", key).select(
        "*", _placer(shards)("key").alias("shard"), _placer(shards + 1)("key").alias("grown_shard"), F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket")
    )
    placed = materialize(placed, "placed")  # narrow: the texts are read once
    cells = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    starts = cells.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    in_cell = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    slotted = placed.withColumn("before", F.sum("copies").over(in_cell) - F.col("copies")).join(starts, ["shard", "bucket"])
    first = F.col("start") + F.col("before")
    return slotted.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard"
    )
