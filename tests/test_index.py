"""The stored search index against the scan, through inserts, replacements and deletions."""

import pytest
from pyspark.sql import functions as F

from engramix.operators import search
from engramix.operators.index import LostRace, SearchIndex, content_of

SHAPE = "id long, chunk_text string, source_file string, chunk_type string, agent string"
ASKED = ["alpha", "beta gamma", "omega OR delta", "alpha NOT beta", "sigma"]


def chunks_of(spark, texts):
    return spark.createDataFrame([(i, t, f"f{i % 3}.md", "daily" if i % 2 else "lesson", f"a{i % 2}") for i, t in texts.items()], SHAPE)


def same(spark, index, chunks, content):
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    for by in ([], ["agent"]):
        got = search.bm25(queries, None, by, **index.of(content, by))
        want = search.bm25(queries, chunks, by)
        rows = lambda df: sorted((r.query_id, r.id, r.base_rank, round(r.bm25, 9)) for r in df.collect())
        assert rows(got) == rows(want) and rows(want)


def test_index_follows_its_chunks(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", ["agent"], parts=4)
    texts = {1: "alpha beta", 2: "gamma delta", 3: "alpha alpha omega", 4: "beta gamma"}
    assert index.of("a") == {} and index.refresh(chunks_of(spark, texts), "a") == 4
    same(spark, index, chunks_of(spark, texts), "a")
    texts[2] = "omega sigma"  # replaced: as many chunks as before
    assert index.of("b") == {} and index.refresh(chunks_of(spark, texts), "b") == 2
    same(spark, index, chunks_of(spark, texts), "b")
    del texts[1]
    texts[9] = "alpha delta beta gamma"
    assert index.refresh(chunks_of(spark, texts), "c") == 2 and index.refresh(chunks_of(spark, texts), "c") == 0
    same(spark, index, chunks_of(spark, texts), "c")
    assert index.of("b") == {} and index.version() == 3 and len(index.state()["segments"]) == 3
    assert len(index.state(1)["segments"]) == 1  # an older version is whole


def test_many_refreshes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("engramix.operators.index.MERGE", 2)
    index = SearchIndex(spark, f"file://{tmp_path}/index", ["agent"], parts=2)
    for n in range(4):
        chunks = chunks_of(spark, {k: f"alpha sigma w{k + n}" for k in range(3)} | {8: "beta gamma omega"})
        index.refresh(chunks, str(n))
    assert len(index.state()["segments"]) == 2
    same(spark, index, chunks, "3")


def test_of_two_writers_one_loses(spark, tmp_path):
    one, other = (SearchIndex(spark, f"file://{tmp_path}/index", parts=2) for _ in range(2))
    chunks = chunks_of(spark, {1: "alpha"})
    one.refresh(chunks, "a")
    state = other.state()
    one.refresh(chunks_of(spark, {1: "beta"}), "b")
    with pytest.raises(LostRace):
        other._commit(2, state)
    assert one.state()["content"] == "b"


def test_content_is_of_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    first = content_of(spark, path)
    assert first == content_of(spark, path)
    spark.range(3).withColumn("x", F.lit(1)).write.mode("overwrite").parquet(path)
    assert first != content_of(spark, path)


def test_variants_are_batches_of_their_own(spark):
    chunks = chunks_of(spark, {1: "alpha one", 2: "beta two", 3: "gamma three"}).withColumns({"source_date": F.lit(None).cast("date"), "created_at": F.lit(None).cast("date"), "last_accessed_at": F.lit(None).cast("date"), "access_count": F.lit(0), "importance": F.lit(0.5), "pain": F.lit(0.2), "retention_days": F.lit(90), "tier": F.lit("core"), "section": F.lit(None).cast("string"), "section_boost": F.lit(None).cast("double"), "source_type": F.lit(None).cast("string")})
    queries = spark.createDataFrame([(5, "alpha one")], "query_id long, query string")
    vectors = spark.createDataFrame([(3, [1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 0.0])], "query_id long, vector array<double>")
    found = lambda v: {(r.query_id, r.id, r.match_type) for r in search.hybrid(queries, asked, vectors, chunks, F.lit("2026-01-01").cast("timestamp"), 5, dedupe=False, variants=v).collect()}
    assert found(None) == {(5, 1, "fts"), (5, 3, "semantic")}
    worded = spark.createDataFrame([(5, 0, "alpha one"), (5, 1, "beta"), (5, 2, "three gamma")], "query_id long, batch_no int, query string")
    assert found(worded) == {(5, 1, "fts"), (5, 2, "fts"), (5, 3, "hybrid")}


def test_terms_are_not_exchanged_to_be_counted(spark):
    """Texts are exchanged once, by id; few hits are sent to the chunks, whose texts stay where they are."""
    c = spark.createDataFrame([(i, "f", "some words and some more", "x") for i in range(20)], "id long, source_file string, chunk_text string, chunk_type string")
    plan = search.postings(c)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) == 1 and {(r.token, r.wtf) for r in search.postings(c).filter("id = 3").collect()} == {("some", 2.0), ("words", 1.0), ("and", 1.0), ("more", 1.0), ("f", 0.5), ("x", 0.5)}
    found = search.if_few_asked(c.limit(5), c.limit(1), 5).join(c.select("id"), "id")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
