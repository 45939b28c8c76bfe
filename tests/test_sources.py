import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from engramix.sources import files
from engramix.streaming import streams

NOW = dt.datetime(2026, 1, 15)


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "memory/2026-01-02.md": "# day\n<!-- retention: never -->\n## a\n" + "word " * 40 + "\n## b\n" + "other " * 40,
        "memory/entities/projects/p.md": "---\nagent: x\n---\nThe body\n\n## Timeline\n- 2026 start\n",
        "data.json": '[{"a": 1}, {"a": 2}]',
        "node_modules/skip.md": "no",
        "bad.bin": "no",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path


def test_ingest(spark, tree):
    found = files.read_tree(spark, f"file://{tree}")
    assert {r.source_file for r in found.collect()} == {"memory/2026-01-02.md", "memory/entities/projects/p.md", "data.json"}
    rows = files.ingest(found, F.lit("2026-01-15").cast("timestamp")).collect()
    daily = [r for r in rows if r.chunk_type == "daily"]
    assert len(daily) == 3 and all(r.retention_days is None and str(r.source_date) == "2026-01-02" for r in daily)
    assert {r.section for r in rows if r.chunk_type == "project"} == {"frontmatter", "compiled", "timeline"}
    assert sum(r.source_file == "data.json" for r in rows) == 2
    assert next(r.importance for r in rows if r.section == "compiled") == 0.9
    assert files.read_tree(spark, "file:///nowhere/at/all").count() == 0


def test_replace_and_guard(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "source_file string, chunk_text string")
    new = spark.createDataFrame([("a", "z")], "source_file string, chunk_text string")
    assert {(r.source_file, r.chunk_text) for r in files.replaced(old, new).collect()} == {("a", "z"), ("b", "y")}
    files.guard_store(old, most=2)
    with pytest.raises(files.LargeStore):
        files.guard_store(old, most=1)
    files.guard_store(old, True, 1)


def test_graph_source(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "n1", "label": "One", "type": "class"}, {"id": "n2"}], "links": [{"source": "n1", "target": f"t{i}", "relation": "uses"} for i in range(10)]}))
    got = {r.source_file: r.chunk_text for r in files.read_graph(spark, f"file://{p}").collect()}
    assert got["graph:n1"].count("- uses") == 8 and got["graph:n2"].startswith("n2 (node)")


def test_sessions_and_log(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"role": "user", "content": "hello there"}\n{"role": "tool", "content": "x"}\n{"role": "assistant", "text": "HEARTBEAT ok"}\nnot json\n')
    rows = files.read_sessions(spark, f"file://{tmp_path}/*.jsonl").collect()
    assert [(r.session_key, r.role, r.text) for r in rows] == [("s1", "user", "hello there")]
    parts = {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "part one"}, {"type": "image"}, {"type": "text", "text": "part two"}]}}
    (tmp_path / "s2.jsonl").write_text("\n".join(json.dumps(x) for x in (parts, {"type": "tool", "message": {"role": "user", "content": "not this"}}, {"type": "message", "message": {"role": "user", "content": "a heartbeat story"}}, {"role": "user", "content": "HEARTBEAT_OK yes"}, {"role": "user", "content": "[cron:5] go"})))
    rows = files.read_sessions(spark, f"file://{tmp_path}/*.jsonl", rows and spark.createDataFrame([("s1",)], "session_key string")).orderBy("n").collect()
    assert [(r.session_key, r.text) for r in rows] == [("s2", "part one\npart two"), ("s2", "a heartbeat story")]
    assert files.read_sessions(spark, f"file://{tmp_path}/*.jsonl", since=F.lit("2999-01-01").cast("timestamp")).count() == 0
    (tmp_path / "run.log").write_text("1 OK\n2 FAIL x\n3\n")
    assert [r.state for r in files.read_log(spark, f"file://{tmp_path}/run.log", 2).orderBy(F.desc("n")).collect()] == [None, "FAIL"]
    assert files.grep(spark, f"file://{tmp_path}/run.log", "FAIL").count() == 1


def test_embedding(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "id long, chunk_text string")
    out = files.embedded(chunks, files.hashed_embedding(8), 8, batch=3).collect()
    assert len(out) == 7 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in out)
    wrong = files.embedded(chunks, files.hashed_embedding(4), 8).collect()
    assert all(r.embedding is None and "components" in r.error for r in wrong)
    assert files.missing_vectors(chunks, spark.createDataFrame([(1,)], "id long")).count() == 6


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    for v in range(4):
        files.write_version(spark.range(v + 1), root, f"{v:03}", keep=2)
    assert files.read_version(spark, root).count() == 4
    assert sorted(p.name for p in (tmp_path / "store").glob("v=*")) == ["v=002", "v=003"]
    assert not list((tmp_path / "store").glob("_*"))
    files.restore(spark, root, "002")
    assert files.current_version(spark, root) == "002" and files.read_version(spark, root).count() == 3
    files.write_version(spark.range(1).withColumnRenamed("id", "other"), root, "004", keep=3)
    with pytest.raises(files.BadVersion, match="other columns"):
        files.restore(spark, root, "002")
    files.restore(spark, root, "002", force=True)
    assert files.current_version(spark, root) == "002"
    for wrong in (lambda: files.restore(spark, root, "009"), lambda: files.write_version(spark.range(1), root, "004")):
        with pytest.raises(files.BadVersion):
            wrong()


def test_stores(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/a")
    out = files.read_stores(spark, {"a": f"file://{tmp_path}/a", "b": f"file://{tmp_path}/missing"})
    assert {r.agent for r in out.collect()} == {"a"}
    assert files.read_stores(spark, {"b": f"file://{tmp_path}/missing"}) is None


def test_sinks(spark, tmp_path):
    doc = "# t\n\n## A\none\n\n## B\ntwo\n"
    assert files.inserted_under(doc, "A", "- x") == "# t\n\n## A\none\n- x\n\n## B\ntwo\n"
    assert files.inserted_under(doc, "C", "- x").endswith("## C\n- x\n")
    files.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "place int, line string"), f"file://{tmp_path}/r")
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("part*")) == "a\nb\n"


def test_watch_stream(spark, tree, tmp_path):
    seen = []
    stream = streams.watch_files(spark, f"file://{tree}/memory")
    run = streams.run_ingest(stream, lambda batch, n: seen.extend(r.source_file for r in batch.collect()), f"file://{tmp_path}/ck")
    run.awaitTermination()
    assert len(seen) == 2
    late = streams.run_ingest(stream, lambda batch, n: seen.append(n), f"file://{tmp_path}/ck2", forbidden=(22, 6), hour=lambda: 23)
    with pytest.raises(Exception, match="23 h"):
        late.awaitTermination()
    assert len(seen) == 2
    assert [h for h in range(24) if not streams.allowed(h, (22, 6))] == [0, 1, 2, 3, 4, 5, 22, 23] and streams.allowed(5, None) and streams.allowed(5, (7, 7)) and not streams.allowed(8, (8, 9))


def test_events_are_checked_and_taken_in_once(spark):
    at = F.lit("2026-01-15").cast("timestamp")
    schema = "kind string, session_id string, content string, scope string, host string, seq string"
    rows = [("session_end", " s1 ", "key sk-" + "a" * 30, "app", "mac", None), ("session_end", "s1", "again", "app", "mac", None), ("pre_compact", "s1", "first", None, "", "1"), ("pre_compact", "s1", "second", None, None, "2"), ("bad", "s1", "x", None, None, None), ("session_end", "", "x", None, None, None), ("session_end", "s2", " \n", None, None, None), ("session_end", "s3", "x" * 20_000, None, None, None), ("session_end", "s4", "x", "a b", None, None), ("session_end", "s5", "x", None, "MAC", None), ("session_end", "s6", "x", None, None, "a b"), ("session_end", "s7", "held", None, None, None)]
    events = spark.createDataFrame(rows, schema)
    assert [r.error for r in streams.checked(events).collect()] == [None, None, None, None, "kind", "session_id", "content", "content", "scope", "host", "seq", None]
    store = spark.createDataFrame([('{"kind": "session_end", "session_id": "s7"}',)], "metadata string")
    got = {r.source_file: r for r in streams.taken_in(events, store, at).collect()}
    assert set(got) == {"events/mac/app/s1.md", "events/unknown/unscoped/s1-1.md", "events/unknown/unscoped/s1-2.md"}
    one = got["events/unknown/unscoped/s1-1.md"]
    assert one.chunk_text == "## Compaction digest — unscoped (unknown, 2026-01-15)\n\nfirst" and json.loads(one.metadata)["seq"] == "1" and one.retention_days == 90


def test_once_only_stream(spark, tmp_path):
    rows = [("end", "s", 1, NOW), ("end", "s", 1, NOW + dt.timedelta(minutes=5)), ("end", "s", 2, NOW)]
    spark.createDataFrame(rows, "kind string, session_id string, seq int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.once_only(spark.readStream.schema("kind string, session_id string, seq int, ts timestamp").parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("once").count() == 2


def test_late_events(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for i, day in enumerate((1, 10, 11, 2)):  # Spark's filter of late rows lags a batch
        spark.createDataFrame([(dt.datetime(2026, 1, day), "e", 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late{i}")
    (tmp_path / "in").mkdir()
    for i in range(4):
        for f in (tmp_path / f"late{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = streams.tumbling(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.start.day for r in spark.table("late").collect()] == [1]  # the one of the 2nd came a week late
