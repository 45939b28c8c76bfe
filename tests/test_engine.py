import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramix import schemas
from engramix.engine import Engine
from engramix.operators import extract, reports

NOW = dt.datetime(2026, 1, 15)


@pytest.fixture
def store(spark, tmp_path):
    rows = [
        (1, "memory/decisions.md", "- **2026-01-14:** we keep parquet as the store format", "decision", dt.date(2026, 1, 14)),
        (2, "memory/x.md", "parquet files are small here", "other", dt.date(2026, 1, 15)),
        (3, "memory/pending.md", "migrate the old parquet store", "pending", dt.date(2026, 1, 10)),
    ]
    df = spark.createDataFrame(rows, "id long, source_file string, chunk_text string, chunk_type string, source_date date")
    schemas.migrated(df, "chunks").withColumn("created_at", F.lit(NOW)).write.parquet(f"{tmp_path}/chunks")
    spark.createDataFrame([(1, "Ann", "person", 3), (2, "Store", "project", 5)], "id long, name string, entity_type string, mention_count long").write.parquet(f"{tmp_path}/kg_entities")
    spark.createDataFrame([(1, 1, "works_on", 2, "extends")], "id long, source_id long, relation_type string, target_id long, reason string").write.parquet(f"{tmp_path}/kg_relations")
    return Engine(spark, f"file://{tmp_path}", NOW)


def test_engine(store, tmp_path):
    assert sorted(r.id for r in store.search("parquet store", 5).collect()) == [1, 3]
    assert store.search("nothing like it").count() == 0
    assert {(r.section, r.line[:10]) for r in store.primer().collect()} == {("decisions", "- **2026-0"), ("today", "parquet fi"), ("pending", "migrate th")}
    assert store.digest().count() == 2
    assert store.kg_path(1, 2).first().depth == 1
    assert store.kg_query("ann").count() == 1
    assert store.kg_impact(1).first().score == 12.0
    assert store.answer("parquet store", lambda p: "[chunk_1]")["citations"] in ([1], [3])
    assert {r.check: r.ok for r in store.doctor().collect()} == {"vectors": False, "consolidation": True}
    assert {r.place for r in store.brief("memory", n=3).collect()} == {1, 2, 3}
    assert store.brief("global", "bot", since="2w").count() == 3 and store.brief("elsewhere").count() == 0
    for wrong in (("",), ("a b",), ("memory", "Bad Agent"), ("memory", "", 3, 1200, "9y")):
        with pytest.raises(ValueError):
            store.brief(*wrong)
    found = [tuple(r) for r in store.search("parquet OR store", 5).collect()]
    store.build_index()
    assert [tuple(r) for r in store.search("parquet OR store", 5).collect()] == found and store._index().keys() == {"index", "stats", "parts"}
    hybrid = store.answer("parquet store", lambda p: "[chunk_1]", vector=[1.0, 0.0])
    assert hybrid["citations"] in ([1], [3])
    assert store.decide("k", "keep it").first().version == 1
    store.track(store.search("files"))
    store.track(store.search("parquet files"))
    assert {r.id: r.access_count for r in store.accessed().collect()} == {1: 0, 2: 2, 3: 0}
    said = store.reflect("Which Store does Ann use?", lambda p: "parquet" if "\n- Store -> Ann" in p and "- Ann (person) rels: works_on -> Store" in p else p)
    assert said["answer"] == "parquet" and store.remember(said["entry"]).count() == 1
    assert store.kg_block("ann and store").first().block.startswith("<vault-facts>\nAnn works_on Store [extends]")
    assert store.error("TypeError", "x").first().status == 500
    assert store.merge_candidates(store.table("kg_relations").selectExpr("source_id AS entity_id", "id AS chunk_id")).count() == 0
    events = store.spark.createDataFrame([("session_end", "s1", "all went well here", None, None, None), ("other", "s1", "x", None, None, None)], "kind string, session_id string, content string, scope string, host string, seq string")
    assert [r.source_file for r in store.take_in(events).collect()] == ["events/unknown/unscoped/s1.md"]
    for name in ("stats", "salience", "tiers", "kg_merge_preview", "kg_prune", "proposals", "audit", "decisions", "kg_stats", "tier_stats", "retention_stats", "archive_candidates", "shared_stats", "profile", "search_stats", "provider_costs", "coverage", "pending_days"):
        getattr(store, name)().collect()
    assert [df.count() for df in store.insights()] == [0, 0]
    assert store.decision_get("k").count() == store.pull_shared("a").count() == 0
    assert store.kg_facts("ann and store").count() == 1
    assert store.redact("key sk-" + "a" * 30).first()["count"] == 1
    assert store.noise_check("ok").first().noise and store.temporal("on 2025-01-02").first().source == "iso_date"
    assert store.classify("memory/feedback/a.md").first().chunk_type == "feedback"
    assert store.vectorize(lambda t: [[1.0, 0.0]] * len(t), 2).count() == 3
    assert store.kg_extract(lambda t: {"relations": [{"source": "a", "type": "uses", "target": "b"}]}).count() == 1
    entities, edges = store.kg_build({"person": ["we"], "project": ["parquet"]})
    assert (entities.count(), edges.count()) == (2, 1)
    note = tmp_path / "notes" / "memory" / "2026-01-15.md"
    note.parent.mkdir(parents=True)
    note.write_text("## today\n" + "we wrote some words " * 10)
    assert store.ingest(f"file://{tmp_path}/notes").count() == 4


def test_command_line(store, spark, tmp_path, capsys):
    from engramix.__main__ import main

    main([f"file://{tmp_path}", "stats"])
    assert "decision" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([f"file://{tmp_path}", "search"])


def test_migration(spark):
    out = schemas.migrated(spark.createDataFrame([(1, 7)], "id int, other int"), "chunks")
    assert out.schema.simpleString() == schemas.schema("chunks").simpleString() and out.first().tier == "peripheral"


def test_anchors(spark):
    df = spark.createDataFrame([("O erro no banco: use reindex, MAX_SIZE and fooBar in v1.2.3 of app_main.py, Acme",)], "t string")
    got = df.select(extract.anchors(F.col("t"), ["acme"]).alias("a")).first().a.split(" ")
    assert {"error", "database", "reindex", "reindexar", "max_size", "foobar", "v1.2.3", "app_main.py", "acme"} <= set(got) and got == sorted(got)


def test_rules_and_models(spark):
    rows = [(1, "---\nreferences: [projects/x]\n---\nbody", "compiled", "entity"), (2, "see [[lessons/l1]] and src/a.py", "notes", "note"), (3, "R$ 10 and 5% on 01/02/2024", None, "note"), (4, "plain", None, "note")]
    chunks = spark.createDataFrame(rows, "id long, chunk_text string, section string, chunk_type string")
    found = extract.by_rule(chunks)
    assert {(r.id, r.relation_type, r.method) for r in found.collect()} == {(1, "references", "frontmatter"), (2, "mentions", "wikilink"), (2, "references", "code_ref")}
    assert {r.id: r.model for r in extract.needs_model(chunks, found).collect()} == {1: False, 2: True, 3: True, 4: True}

    def model(body):
        if body == "plain":
            raise TimeoutError("late")
        return {"relations": [{"source": "a", "type": "Requires", "target": "b"}]}

    out = {r.id: r for r in extract.with_model(chunks, model).collect()}
    assert out[4].error == "late" and "value_brl" in out[3].entities
    triples = extract.model_relations(extract.with_model(chunks, model)).collect()
    assert [(r.source, r.reason) for r in triples] == [("a", "depends_on")]
    said = spark.createDataFrame([(2, "mentions", "lessons/l1"), (2, "uses", "z")], "id long, relation_type string, target string")
    assert {(r.target, r.method) for r in extract.combined(found, said).filter("id = 2").collect()} == {("lessons/l1", "wikilink"), ("src/a.py", "code_ref"), ("z", "llm")}


def test_small_columns(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2"}', '{"b": "3"}', "key sk-" + "a" * 30)], "o string, n string, t string")
    r = df.select(extract.merged_attributes(F.col("o"), F.col("n")).alias("m"), extract.event_secrets(F.col("t")).alias("s")).first()
    typed = spark.createDataFrame([('{"a":{"x":1},"n":5,"t":true,"z":null,"l":[1,"2"]}', '{"n":6.5,"m":{"y":[{}]}}'), (None, '{"k":1}'), ("[1]", "no json")], "o string, n string").select(extract.merged_attributes(F.col("o"), F.col("n")).alias("m"))
    assert [x.m for x in typed.collect()] == ['{"a":{"x":1},"t":true,"z":null,"l":[1,"2"],"n":6.5,"m":{"y":[{}]}}', '{"k":1}', "{}"]
    assert r.m == '{"a":"1","b":"3"}' and r.s.text == "key [REDACTED]" and r.s["count"] == 1
    lines = spark.createDataFrame([("## 2026-03-10 — Something decided",), ("**Decisão:** x",), ("nothing",)], "t string").select(reports.decision_line(F.col("t")).alias("l"))
    assert [r.l for r in lines.collect()] == ["- 2026-03-10 — Something decided", "- **Decisão:** x", None]


def test_consolidation(spark):
    chunks = spark.createDataFrame([(1, "d1.md", "we decided to keep the store as it is", "daily", dt.date(2026, 1, 1)), (2, "d2.md", "another long enough line of text", "daily", dt.date(2026, 1, 2)), (3, "d3.md", "third", "daily", dt.date(2026, 1, 3))], "id long, source_file string, chunk_text string, chunk_type string, source_date date")
    done = spark.createDataFrame([("d3.md", 1)], "source_file string, status int")
    days = extract.pending_days(chunks, done)
    assert {r.source_file for r in days.collect()} == {"d1.md", "d2.md"}

    def model(body):
        if "another" in body:
            raise TimeoutError
        return {"decisions": ["keep"]}

    assert {(r.source_file, r.status, r.text) for r in extract.consolidated(chunks, days, model).collect()} == {("d1.md", 1, "keep"), ("d2.md", -1, None)}
    messages = spark.createDataFrame([("s", i, "user", f"message number {i} with text") for i in range(5)] + [("t", 0, "user", "only one message here")], "session_key string, n long, role string, text string")
    got = extract.blocks(messages, 60).orderBy("block").collect()
    assert {r.session_key for r in got} == {"s"} and len(got) > 1 and sum(r.text.count("[USER]:") for r in got) == 5
    known = spark.createDataFrame([(1, "the known memory of things"), (2, "other")], "id long, chunk_text string")

    def memories(body):
        if "number 4" in body:
            raise TimeoutError
        return [{"text": "the known memory of things", "category": "fact", "importance": 0.9}, {"text": "fresh memory", "category": "fact", "importance": 0.85}, {"text": "weak", "importance": 0.2}]

    kept = extract.distilled(extract.blocks(messages, 60).withColumn("session_key", F.lit("bot:s")), memories, known, F.lit(NOW)).collect()
    assert [(r.source_file, r.chunk_text, r.tier) for r in kept] == [("sessions/bot/s", "[fact|bot] fresh memory", "working")]
    found = spark.createDataFrame([("memory/2026-01-02.md", 1, "decisions", "keep it"), ("memory/2026-01-03.md", 1, "decisions", "keep it"), ("x.md", 1, "people", "other"), ("y.md", 1, None, None), ("z.md", -1, None, None)], "source_file string, status int, kind string, text string")
    assert [(r.file, r.line) for r in extract.sink_lines(found, known).collect()] == [("memory/decisions.md", "- **2026-01-02:** keep it")]
    daily = spark.createDataFrame([("y.md", "some short empty words"), ("y.md", "long " * 60), ("z.md", "failed words of text")], "source_file string, chunk_text string")
    assert [r.text_normalized for r in extract.learned_noise(daily, found).collect()] == ["some short empty words"]
    guides = spark.createDataFrame([("atlas", "nothing of it")], "agent string, guide string")
    lesson = spark.createDataFrame([(9, "Atlas should always verify backups", "lesson", dt.date(2026, 1, 10))], "id long, chunk_text string, chunk_type string, source_date date")
    assert [r.agent for r in reports.gaps(lesson, guides, F.lit(NOW)).collect()] == ["atlas"]
