"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_FOLDERS: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/quadrille-checkpoints"


def _filesystem(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A place in the shared folder that nothing is at yet; `sweep` or the end of the driver's process deletes what was put there."""
    folder = f"{shared_dir(spark)}/quadrille/{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = _filesystem(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Cut lineage by writing a table into the shared folder and reading it back.

    The files are visible to every executor, so a lost executor costs a re-read and no recomputation.  What
    `discard` doesn't delete, `sweep` or the end of the driver's process does.  Tables whose rows are megabytes long say
    how many of them a row group may hold: writers look at a group's size after 100 rows only, and readers hold a group at a
    time.  Such tables have no statistics, since a writer keeps each group's least and greatest values whole until its file ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    more = {"parquet.block.row.count.limit": group_rows, "parquet.column.statistics.enabled": False} if group_rows else {}
    df.write.mode("overwrite").options(compression=codec, **more).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that later tables have replaced."""
    for df in tables:
        files, where = _filesystem(df.sparkSession, df._table_path)
        files.delete(where, True)


def sweep() -> None:
    """Delete every table that this process has materialised; results that still read one can't be computed any more."""
    while _FOLDERS:
        _, (files, where) = _FOLDERS.popitem()
        try:
            files.delete(where, True)
        except Exception:  # the JVM has gone before us: nothing can be deleted from here
            return


atexit.register(sweep)
