"""Tables in the cluster's shared folder that cut lineage, and versions of stored tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and the master is local (as in tests), one of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="engramix-"))
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/engramix-{uuid.uuid4().hex[:12]}-{name}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, lost executors cost no
    recomputation beyond their running tasks. by: columns of the table's folders; readers skip those they don't ask for.
    The table is removed by drop(), or when the driver's Python ends."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out to all cores (by columns, if given), where much work is done on each row: a table in one file may have one row group, and
    so one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that stored() has returned; nothing that reads them can be used any more."""
    for df in frames:
        _, path = _PATHS.pop(id(df))
        _MADE.remove((df.sparkSession, path))
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Delete the tables that are left; frames that read them can't be used any more."""
    _PATHS.clear()
    while _MADE:
        spark, path = _MADE.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return


atexit.register(clear)
