"""Every query against its oracle's SQL in another engine."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from engramix.operators import brief, extract, search
from engramix.plans import catalog, views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (int, float, np.integer)) and not isinstance(x, bool):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(shown(x) for x in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle(folder):
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(name, spark, folder, oracle):
    got = rows(catalog.QUERIES[name](spark, folder).toPandas())
    assert got == rows(oracle.sql(catalog.ORACLES[name]).df())


def test_queries_without_sql_are_held_otherwise():
    """Each of them against brute force below, or in the operators' tests."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"h11_anchors", "i13_hybrid_thinned", "i18_near_copies", "l01_brief"}


def test_anchors_match_brute_force(spark, folder):
    given = {t: [t] for t in extract.COGNATES}
    for pt, en in extract.TRANSLATIONS.items():
        given.setdefault(pt, []).append(en)
        given.setdefault(en, []).append(pt)
    word = "[A-Za-z0-9_]"
    got = {r.doc_id: r.anchors for r in catalog.QUERIES["h11_anchors"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        body = f"{r.text} erro no banco v1.2.3 MAX_SIZE"
        want = set()
        for term, outs in given.items():
            end = f"(?!{word})" if len(term) <= 3 and re.fullmatch(f"{word}+", term) else ""
            shape = "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in term)
            if re.search(f"(?<!{word}){shape}{end}", body):
                want |= set(outs)
        for p in extract._IDENTIFIERS:
            want |= {m.lower() for m in re.findall(p, body, re.ASCII) if len(m) >= 4}
        assert got[r.doc_id] == " ".join(sorted(want)), r.doc_id


def test_anchors_are_sought_by_all_cores(spark, folder):
    found = catalog.QUERIES["h11_anchors"](spark, folder)
    assert found.rdd.getNumPartitions() > 1  # the table is one file of one row group
    assert "exists(" not in found._jdf.queryExecution().optimizedPlan().toString()  # words aren't compared with each term


def test_thinned_results_match_brute_force(spark, folder):
    c = views.chunks(spark, folder)
    asked = spark.createDataFrame([(0, "no para"), (1, "que la")], "query_id long, query string")
    vector = spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id = 7").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    fused = search.hybrid(asked, vector, vectors, c, views.now(), 5, dedupe=False).drop("source_file").join(c.select("id", "source_file", "chunk_text", "chunk_type", "section"), "id").collect()
    want = set()
    for q in (0, 1):
        kept, files = [], {}
        for r in sorted((r for r in fused if r.query_id == q), key=lambda r: r.rank):
            files[r.source_file] = files.get(r.source_file, 0) + 1
            words = r.chunk_text[:180].lower().split()
            own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}
            if files[r.source_file] <= 3 and not any(len(own & s) >= 0.85 * len(own | s) for _, s in kept):
                kept.append((r, own))
        rows = [r for r, _ in kept]
        first, late, kinds = [], [], {}
        for r in rows:
            kinds[r.chunk_type] = kinds.get(r.chunk_type, 0) + 1
            (first if kinds[r.chunk_type] <= 3 else late).append(r)
        rows = first + late if len(first) < 5 else first
        out, files = [], {}
        for r in rows:
            if files.get(r.source_file, 0) < (3 if r.section else 2) and len(out) < 5:
                files[r.source_file] = files.get(r.source_file, 0) + 1
                out.append((q, r.id))
        want |= set(out)
    assert {(r.query_id, r.id) for r in catalog.QUERIES["i13_hybrid_thinned"](spark, folder).collect()} == want and want


def test_brief_of_the_table(spark, folder):
    rows = catalog.QUERIES["l01_brief"](spark, folder).collect()
    now = [r for r in rows if r.place is not None]
    assert sorted(r.place for r in now) == list(range(1, 11)) and len({(r.title, r.line) for r in now}) == 10
    best = sorted(now, key=lambda r: r.place)
    assert [r.brief_score for r in best] == sorted((r.brief_score for r in best), reverse=True) and sum(r.fresh for r in now) <= 2
    assert sum(r.change == "would_enter" for r in now) == sum(r.change == "would_leave" for r in rows)
    assert not any(r.pain >= brief.PAIN_FLOOR for r in rows if r.change == "would_leave")


def test_near_copies_of_the_table(spark, folder):
    """Cosine with the five best lexical hits, one query at a time."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.vec_id in docs}
    c = views.chunks(spark, folder)
    some = [i for i in sorted(vectors) if i in docs][:12]
    asked = spark.createDataFrame([(i, " ".join(docs[i].split()[:8])) for i in some], "query_id long, query string")
    hits = {}
    for r in search.bm25(asked, c, limit=6).orderBy("query_id", "base_rank").collect():
        if r.id != r.query_id:
            hits.setdefault(r.query_id, []).append(r.id)
    want = {}
    for i in some:
        for j in hits.get(i, [])[:5]:
            if j in vectors and float(vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j])) >= 0.85:
                want[i] = j
                break
    got = {r.id: r.match_id for r in catalog.QUERIES["i18_near_copies"](spark, folder).collect() if r.cosine is not None and r.id in some}
    assert got == want


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


LATE = " [[people/late]] src/late/file.py:77 lib.v9.8.7 LATE_NAME Europe critical outage Marie Curie "


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder whose documents have what the operators look for after thousands of characters."""
    to = tmp_path_factory.mktemp("long")
    rows = [(i, "plain words " * 500 + (LATE if i % 2 else ""), "en", "s", 6000) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, "EUROPE"), (2, "ASIA"), (3, "plain")], "r_regionkey long, r_name string").write.parquet(f"{to}/region.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["h01_sanitized", "h02_folded", "h08_facts", "h09_links", "h11_anchors"])
def test_whole_texts_are_read(name, spark, long_texts):
    got = {r.doc_id: [] for r in catalog.QUERIES[name](spark, long_texts).collect()}
    for r in catalog.QUERIES[name](spark, long_texts).collect():
        got[r.doc_id].append(str(r).lower())
    word = {"h08_facts": "marie curie", "h09_links": "src/late/file.py", "h11_anchors": "late_name"}.get(name, "curie")
    assert all((word in " ".join(got.get(i, []))) == bool(i % 2) for i in range(12))


def test_words_of_whole_texts_count(spark, long_texts):
    pain = {r.doc_id: r.pain for r in catalog.QUERIES["h15_inferred_pain"](spark, long_texts).collect()}
    assert all(pain[i] == 0.8 for i in range(12) if i % 2 or i % 3 < 2) and pain[2] == 0.3
    names = {r.query_id: r.entities for r in catalog.QUERIES["i10_entity_count"](spark, long_texts).collect()}
    assert set(names.values()) == {3}  # "plain" comes after the first words only
    model = catalog.QUERIES["j13_extraction_gate"](spark, long_texts).collect()
    assert sum(r.n for r in model) == 12


def test_whole_tables_are_covered(spark, folder):
    docs = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    vectors = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r.id for r in catalog.QUERIES["a17_embedded"](spark, folder).collect()) == sorted(docs)
    asked = {r.query_id for r in catalog.QUERIES["n04_cached_reflections"](spark, folder).collect()}
    assert asked >= {v for v in vectors if v % 2 == 0 and v % 30 <= 24}  # each has itself in the cache
    lengths = {r.doc_id: r.text and len(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = set()
    for q in {d // 50 for d in docs}:
        best = sorted((d for d in docs if d // 50 == q), key=lambda d: (-lengths[d], d))[:10]
        want |= {(q, d, i + 1) for i, d in enumerate(best)}
    assert {tuple(r) for r in catalog.QUERIES["i16_reranked"](spark, folder).collect()} == want


def test_brief_uses_the_whole_log(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(brief, "build", lambda chunks, log, *rest: seen.append(log) or log)
    catalog.QUERIES["l01_brief"](spark, folder)
    assert seen[0].count() == spark.read.parquet(f"{folder}/events.parquet").count()
