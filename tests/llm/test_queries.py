"""The registered queries, their oracles, and the pipeline."""

import collections
import html
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from engramix.llm import bestfit, language, queries, tokens
from tests.llm.test_operators import brute_components, brute_contamination
from tests.test_catalog import TABLES, rows


@pytest.fixture(scope="module")
def oracle(folder):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(name, spark, folder, oracle):
    assert rows(queries.queries()[name](spark, folder).toPandas()) == rows(oracle.sql(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(name, spark, folder):
    assert queries.queries()[name](spark, folder).count() > 0


def test_near_duplicates_of_the_table(spark, folder):
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    sizes, roots = brute_components([d.text for d in docs])
    want = {(d.doc_id, n, docs[r].doc_id) for d, n, r in zip(docs, sizes, roots, strict=True)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op2_ngram_jaccard_join(spark, folder).collect()} == want


@pytest.fixture(scope="module")
def ids(spark, folder):
    """Each document's ids, by the library's default call."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.public_bpe()[0])
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {d.doc_id: np.array([*slow.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4") for d in docs}


def test_packed_pieces_of_the_table(spark, folder, ids):
    rows = queries.op5_best_fit_packing(spark, folder).collect()
    want = {(d, k, a, n, zlib.crc32(v[a : a + n].tobytes())) for d, v in ids.items() for k, (a, n) in enumerate(tokens.cut(len(v), bestfit.CAPACITY))}
    assert len(rows) == len(want) and {r[:5] for r in rows} == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert len(held) <= -(-sum(map(len, ids.values())) // 1024) * 1.01 + 1


def test_packed_ids_of_the_table(spark, folder, ids):
    seen = collections.Counter()
    for r in queries.op3_packed_ids(spark, folder).collect():
        row, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(row) == len(places) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b, g in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments, strict=False):
            assert np.array_equal(row[a:b], ids[g.doc_id][g.start : g.start + g.length]) and np.array_equal(places[a:b], np.arange(b - a))
            seen[g.doc_id] += b - a
    assert seen == {d: len(v) for d, v in ids.items()}


def test_languages_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2}
    drawn = {}

    def bundle(text):
        words = [w for w in re.split(r"[^\w]|[\d_]", text.lower()) if w]
        letters = "".join("\0" + w for w in words) + "\0" if words else ""
        for c in set(letters) - set(drawn):
            drawn[c] = language.letter_vectors(np.array([ord(c)]), language.DIM)[0].astype(float)
        grams = collections.Counter(zip(letters, letters[1:], letters[2:], strict=False))
        return sum((n * np.roll(drawn[a], 2) * np.roll(drawn[b], 1) * drawn[c] for (a, b, c), n in grams.items()), np.zeros(language.DIM))

    bundles = {d.doc_id: bundle(d.text or "") for d in docs}
    sums = {}
    for d in docs:
        if d.doc_id not in held and d.lang is not None:
            sums[d.lang] = sums.get(d.lang, 0) + bundles[d.doc_id]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for r in queries.op6_language_id(spark, folder).collect():
        near = {k: float(unit(bundles[r.doc_id]) @ unit(v)) for k, v in sums.items()}
        assert r.held_out == (r.doc_id in held) and r.score == pytest.approx(max(near.values()), abs=1e-6) and near[r.lang_pred] == pytest.approx(max(near.values()), abs=1e-6)


def test_articles_of_the_table(spark, folder):
    """These pages have one article each; its blocks are what is between its block tags."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op9_html_text(spark, folder).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|ul|li|div|blockquote|table|tr|td)\b[^>]*>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        if name == "quality_classifier":
            judged = [i for i in before if i in labels]
            assert sum((i in after) == bool(labels[i]) for i in judged) / len(judged) > 0.95
        elif name == "language_id":
            assert len(after) == len(before)
        elif name == "ngram_jaccard_join":
            ids = sorted(before)
            _, roots = brute_components([before[i] for i in ids])
            assert set(after) == {ids[r] for r in roots}
        else:
            found = brute_contamination(before.values(), bench)
            assert set(after) == {i for i, f in zip(before, found, strict=True) if not f[4]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == set(after)
    assert corpus_pipeline.run(spark, folder).count() == last.count()
