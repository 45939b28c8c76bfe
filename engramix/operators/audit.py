"""Audited runs: an append-only log of what runs did, its present state, and a stream that ends runs whose heartbeat has stopped.

A log's rows have the columns of `ops_audit`. A run writes one when it begins, one for each heartbeat and one when it ends; nothing
is ever changed, so writers need no lock and a reader sees whole rows.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import schemas
from engramix.operators.extract import audit_scrubbed
from engramix.streaming.streams import told

#: What a run's end outweighs: a run that was given up may still end by itself.
_FINAL = {"running": 0, "crashed": 1}
GIVEN_UP = "no heartbeat"


def _rank(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, n) for s, n in _FINAL.items()), F.lit(2))


def _at() -> Column:
    """When a row was written."""
    return F.coalesce("finished_at", "last_heartbeat_at", "started_at")


@dataclass
class Run:
    """A run under audit: set affected_rows and notes, call heartbeat() now and then."""

    spark: SparkSession
    path: str
    op_name: str
    db_source: str | None
    op_id: int
    started_at: dt.datetime
    affected_rows: int | None = None
    notes: str | None = None

    def write(self, status: str, finished: dt.datetime | None = None, error: str | None = None) -> None:
        now = finished or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        took = int((now - self.started_at).total_seconds() * 1000) if finished else None
        row = (self.op_id, self.op_name, self.started_at, finished, took, status, self.affected_rows, os.getpid(), error, self.notes, self.db_source, now)
        log = self.spark.createDataFrame([row], schemas.schema("ops_audit"))
        log.withColumn("error_message", audit_scrubbed(F.col("error_message"))).coalesce(1).write.mode("append").parquet(self.path)

    def heartbeat(self) -> None:
        self.write("running")


@contextmanager
def audited(spark: SparkSession, path: str, op_name: str, db_source: str | None = None) -> Iterator[Run]:
    """Brackets a run in the log at path: running, then success, or failed with the error (without secrets), which goes on to the
    caller. A run that is killed leaves `running` behind, until given_up() ends it."""
    now = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
    run = Run(spark, path, op_name, db_source, uuid.uuid4().int >> 65, now())
    run.write("running")
    try:
        yield run
    except BaseException as e:
        run.write("failed", now(), f"{type(e).__name__}: {e}")
        raise
    run.write("success", now())


def present(log: DataFrame) -> DataFrame:
    """One row for each run: how it ended, else that it was given up, else its last heartbeat. Rows without an op_id are runs of
    their own; of rows of one state and time the last by the other columns."""
    names = log.columns
    known = log.filter("op_id IS NOT NULL").groupBy("op_id").agg(F.max(F.struct(_rank(F.col("status")).alias("_rank"), _at().alias("_at"), *names)).alias("r"))
    return known.select(*(F.col(f"r.{c}").alias(c) for c in names)).unionByName(log.filter("op_id IS NULL"))


def given_up(log: DataFrame, quiet: str = "6 hours", delay: str = "1 minute", as_of: Column | None = None) -> DataFrame:
    """Rows to append to the log: `crashed` for each run that was running when its rows stopped for `quiet`.

    The same for a stream of the log, whose time is that of its rows (add streams.clock() rows to go on without any), and for a
    batch at as_of. A stream keeps a row for each run with an open window; the end of a run in the same window closes it."""
    own = log.withColumn("_at", _at())
    if log.isStreaming:
        own = own.withWatermark("_at", delay)
    own = own.filter(told("op_id", "_at"))
    kept = [c for c in log.columns if c not in ("op_id", "status", "finished_at", "duration_ms", "error_message")]
    last = F.max(F.struct(_rank(F.col("status")).alias("_rank"), F.col("_at").alias("at"), *kept))
    runs = own.groupBy(F.session_window("_at", quiet).alias("w"), "op_id").agg(last.alias("r")).filter("r._rank = 0")
    if as_of is not None:
        runs = runs.filter(F.col("w.end") <= as_of)
    of = {"op_id": F.col("op_id"), "status": F.lit("crashed"), "finished_at": F.col("w.end"), "error_message": F.lit(GIVEN_UP)}
    of["duration_ms"] = F.unix_millis("w.end") - F.unix_millis("r.started_at")
    return runs.select(*(of.get(c, F.col(f"r.{c}") if c in kept else F.lit(None)).alias(c) for c in log.columns))
