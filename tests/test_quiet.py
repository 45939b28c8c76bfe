"""Runs of changes that come to rest: the debounce of a watched folder, and audited runs without a heartbeat."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from engramix import schemas
from engramix.engine import Engine
from engramix.operators import audit
from engramix.streaming import streams

NOW = dt.datetime(2026, 1, 15)
CHANGES = "source_file string, text string, modified timestamp"


def at(seconds):
    return NOW + dt.timedelta(seconds=seconds)


def test_a_run_of_changes_settles_once(spark):
    rows = [("a", "1", at(0)), ("a", "2", at(1)), ("a", "3", at(2.9)), ("e", "1", at(0)), ("e", "2", at(2)), ("a", "4", at(5)), ("b", "x", at(1)), ("b", "y", at(1)), (None, "z", at(1)), ("c", "z", None), ("d", None, at(0))]
    got = streams.settled(spark.createDataFrame(rows, CHANGES)).collect()
    # a gap of over two seconds ends a run; of one time the last text counts
    assert sorted((r.source_file, r.text or "", r.changes, r.first, r.modified) for r in got) == [("a", "3", 3, at(0), at(2.9)), ("a", "4", 1, at(5), at(5)), ("b", "y", 2, at(1), at(1)), ("d", "", 1, at(0), at(0)), ("e", "2", 2, at(0), at(2))]
    assert streams.settled(spark.createDataFrame([], CHANGES)).count() == 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    def add(n, rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = streams.settled(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source_file, r.text, r.changes) for r in spark.read.schema("source_file string, text string, changes long").parquet(f"{tmp_path}/out").collect())

    add(0, [("a", "old", at(0)), ("a", "new", at(1)), ("b", "half", at(10))])
    assert run() == [("a", "new", 2)]  # b may still change
    add(1, [("b", "whole", at(11))])
    assert run() == [("a", "new", 2)]
    add(2, [(None, None, at(60))])  # a clock's row
    assert run() == [("a", "new", 2), ("b", "whole", 2)]
    assert run() == [("a", "new", 2), ("b", "whole", 2)]


def test_the_last_change_of_a_quiet_folder_settles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello")
    seen = []
    run = Engine(spark, f"file://{tmp_path}/store").watch(f"file://{tmp_path}/in", lambda batch, n: seen.extend((os.path.basename(r.source_file), r.text) for r in batch.collect()), f"file://{tmp_path}/ck", every="1 second")
    until = time.time() + 90
    while not seen and time.time() < until and run.isActive:
        time.sleep(0.5)
    run.stop()
    assert seen == [("a.md", "hello")]


def test_audited_runs(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}", dt.datetime.now(dt.UTC).replace(tzinfo=None) + dt.timedelta(minutes=1))
    with store.audited("reindex", "main") as run:
        run.heartbeat()
        run.affected_rows = 7
    with pytest.raises(ValueError, match="bad"), store.audited("compact") as failing:
        raise ValueError("bad key sk-" + "a" * 30)
    killed = audit.Run(spark, f"file://{tmp_path}/ops_audit", "ingest", "main", 5, dt.datetime.now(dt.UTC).replace(tzinfo=None))
    killed.write("running")
    now = {r.op_name: r for r in audit.present(store.table("ops_audit")).collect()}
    assert {k: r.status for k, r in now.items()} == {"reindex": "success", "compact": "failed", "ingest": "running"}
    assert now["reindex"].affected_rows == 7 and now["reindex"].duration_ms >= 0 and now["compact"].op_id == failing.op_id
    assert "sk-[REDACTED]" in now["compact"].error_message and "aaaa" not in now["compact"].error_message
    assert {r.db_source: (r.success, r.failed, r.crashed, r.running) for r in store.audit().collect()} == {"main": (1, 0, 0, 1), "unknown": (0, 1, 0, 0)}
    assert store.give_up() == 0
    later = Engine(spark, f"file://{tmp_path}", dt.datetime.now(dt.UTC).replace(tzinfo=None) + dt.timedelta(hours=7))
    assert later.give_up() == 1 and later.give_up() == 0
    (dead,) = [r for r in audit.present(later.table("ops_audit")).collect() if r.op_id == 5]
    assert (dead.status, dead.op_name, dead.error_message, dead.db_source) == ("crashed", "ingest", audit.GIVEN_UP, "main") and dead.duration_ms >= 6 * 3600 * 1000
    killed.write("success", dt.datetime.now(dt.UTC).replace(tzinfo=None))  # it was only slow
    assert {r.status for r in audit.present(later.table("ops_audit")).filter("op_id = 5").collect()} == {"success"}


def _log(spark, rows):
    frame = spark.createDataFrame([(i, s, at(t)) for i, s, t in rows], "op_id long, status string, last_heartbeat_at timestamp")
    return schemas.migrated(frame.withColumns({"started_at": F.lit(NOW), "op_name": F.lit("op")}), "ops_audit")


def test_runs_without_a_heartbeat_are_given_up(spark, tmp_path):
    rows = [(1, "running", 0), (1, "running", 50), (1, "success", 60), (2, "running", 0), (2, "running", 90), (3, "running", 0), (3, "running", 500), (None, "running", 0), (4, "failed", 10), (4, "running", 20)]
    log = _log(spark, rows)
    got = {r.op_id: r.finished_at for r in audit.given_up(log, "100 seconds", as_of=F.lit(at(400))).collect()}
    assert got == {2: at(190), 3: at(100)}  # 4 has ended, a late heartbeat doesn't count
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    out = audit.given_up(stream, "100 seconds", "1 second")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    dead = spark.read.schema(log.schema).parquet(f"{tmp_path}/out")
    assert {r.op_id: r.finished_at for r in dead.collect()} == got
    assert dead.columns == log.columns
    assert audit.present(log.filter("op_id IS NULL")).count() == 1 and audit.present(log).count() == 5
    assert audit.given_up(log.limit(0), as_of=F.lit(at(1))).count() == 0
