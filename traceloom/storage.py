"""Tables between jobs: written to the folder that driver and executors share, so lost executors cost one table at most."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a folder in the warehouse, if all machines can reach that."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse + "/traceloom-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder that a lazy plan may still read: it goes when the application ends."""
    files, there = _file_system(spark, path)
    files.deleteOnExit(there)


class _Made(threading.local):
    """Folders of the tables that a thread has made so far, so that two pipelines in one driver do not meet."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_MADE = _Made()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, goes with the application."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    _MADE.folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go when the job ends, not when the driver collects its garbage; for rounds of tables that are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tables_made() -> int:
    """How many tables this thread has made."""
    return len(_MADE.folders)


def drop_between(spark: SparkSession, first: int, last: int) -> None:
    """Deletes this thread's tables from the first on and before the last (numbers of tables_made()), which no plan needs any more."""
    for path in _MADE.folders[first:last]:
        files, there = _file_system(spark, path)
        files.delete(there, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() made and that no plan needs any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        files, there = _file_system(df.sparkSession, folder)
        files.delete(there, True)
