"""Tables that are sorted over their files, with the bounds of every file: a page or a key is a seek.

Rows are dealt by range, sorted within their files and written; a small table beside them holds each file's first and
last key and its rows. Reading by key opens the files that can hold the key, so a page of a table costs one or two files
however far down it is, and a word of an index costs the files of that word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_at_exit, new_path
from .filters import col


@dataclass(frozen=True)
class SortedTable:
    """A sorted table at a path, with its key columns in order."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    @cached_property
    def _read(self) -> tuple[DataFrame, DataFrame]:
        """The plans that read bounds and rows; files are looked at for their columns once."""
        return tuple(self.spark.read.parquet(f"{self.path}/{part}") for part in ("bounds", "rows"))

    def bounds(self) -> DataFrame:
        """(file, lo, hi, n): a row for each file; lo and hi are structs of the keys."""
        return self._read[0]

    def rows(self) -> DataFrame:
        return self._read[1]

    def _files(self, found: DataFrame) -> DataFrame:
        """The rows of some files; their names come to the driver, so they are few or the whole table is read."""
        names = [r["file"] for r in found.select("file").collect()]
        rows = self.rows()
        return self.spark.read.schema(rows.schema).parquet(*names) if names else rows.limit(0)

    def where_key(self, *choices: tuple[Column, Column]) -> DataFrame:
        """Rows whose first key is from lo to hi, for each (lo, hi)."""
        first = self.keys[0]
        meets = [(F.col("hi")[first] >= lo) & (F.col("lo")[first] <= hi) for lo, hi in choices]
        within = [col(first).between(lo, hi) for lo, hi in choices]
        return self._files(self.bounds().where(reduce(Column.__or__, meets))).where(reduce(Column.__or__, within))

    def page(self, after: Sequence | None = None, limit: int = 5000, descending: bool = False) -> DataFrame:
        """The next rows after a key (None: from the start), in the order of the keys, nulls first, or in its reverse.

        after: the key values of the last row seen. Opened are the first files that hold the page.
        """
        schema = self.rows().schema
        key = F.struct(*[col(k) for k in self.keys])
        last = None if after is None else F.struct(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(self.keys, after, strict=True)])
        beyond = lambda x: F.lit(True) if last is None else x < last if descending else x > last
        order = key.desc() if descending else key.asc()
        near, far = ("hi", "lo") if descending else ("lo", "hi")
        ahead = self.bounds().where(beyond(F.col(far))).orderBy(F.col(near).desc() if descending else F.col(near).asc())
        # A file after the first holds no row up to `after`, so files with `limit` rows after the first are enough.
        names, whole = [], 0
        for r in ahead.select("file", "n").limit(64).collect():
            whole += r["n"] if names or last is None else 0
            names.append(r["file"])
            if whole >= limit:
                break
        else:
            if len(names) == 64:
                return self.rows().where(beyond(key)).orderBy(order).limit(limit)
        rows = self.spark.read.schema(schema).parquet(*names) if names else self.rows().limit(0)
        return rows.where(beyond(key)).orderBy(order).limit(limit)


def write_sorted(df: DataFrame, keys: Sequence[str], path: str | None = None, files: int | None = None) -> SortedTable:
    """df as a sorted table; without a path it goes with the application. Its last key should tell rows apart."""
    spark, kept = df.sparkSession, path is not None
    path = path or new_path(spark, "sorted")
    columns = [col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    dealt.sortWithinPartitions(*columns).write.parquet(f"{path}/rows")
    key = F.struct(*[col(k) for k in keys])
    written = spark.read.schema(df.schema).parquet(f"{path}/rows")
    per_file = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    per_file.coalesce(1).write.parquet(f"{path}/bounds")
    if not kept:
        delete_at_exit(spark, path)
    return SortedTable(spark, path, tuple(keys))
