"""Shared helpers: tables in the cluster's checkpoint folder, and bounded id filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.sources.files import spread

_MADE: list[tuple[object, str]] = []
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


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python 1000 rows at a time, unless the session asks for another number than Spark's default of 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, lost executors cost
    no recomputation beyond their running tasks. The table is removed when the driver's Python ends or by clear()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/engramix-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that stored() has returned; nothing that reads them can be used any more."""
    for df in frames:
        _, path = _PATHS.pop(id(df))
        _MADE.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Delete the tables that stored() has written so far; frames that read them can't be used any more."""
    _PATHS.clear()
    while _MADE:
        spark, path = _MADE.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


atexit.register(clear)

#: Bits of an id filter, least and most: 1 MB to 64 MB, whatever the size of the data.
FILTER_BITS = 1 << 23, 1 << 29


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap that has a bit for each id of the one-column frame, 16 bits for each of its rows within FILTER_BITS.
    At most 64 MB reach the driver.

    It never misses an id but may let others pass, so an exact join follows; it only keeps texts that can't match
    out of that join's shuffle."""
    (column,) = ids.columns
    bits = min(max(FILTER_BITS[0], 1 << (16 * ids.count()).bit_length()), FILTER_BITS[1])
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits)) + 1  # Spark numbers bitmap positions from 1
    rows = (
        ids.filter(F.col(column).isNotNull())
        .select(place.alias("p"))
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
        .collect()
    )
    out = np.zeros(bits, bool)
    for b, m in rows:
        part = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").astype(bool)
        at = (b - 1) * len(part)
        out[at : at + len(part)] |= part[: bits - at]
    return out


def passes(spark: SparkSession, bitmap: np.ndarray, column: Column) -> Column:
    """True where the id may be in the bitmap; null ids don't pass."""
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))
    bits = len(bitmap)

    @F.pandas_udf(T.BooleanType())
    def held(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool))

    return column.isNotNull() & held(F.pmod(F.xxhash64(column), F.lit(bits)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spread(spark.read.parquet(path), path)
