"""Sets of words against blocks of texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from engramix.operators import blocks, lifecycle, search


def _best(sets, texts, spare):
    """Brute force: the two ids that lack fewest words of each set."""
    want = {}
    for i, words in enumerate(sets):
        lacking = {}
        for key, held in texts:
            n = len(words - held)
            if n <= spare[i]:
                lacking[key] = min(n, lacking.get(key, n))
        want[i] = sorted((n, key) for key, n in lacking.items())[:2]
    return want


@pytest.mark.parametrize(("limit", "cells"), [((4096, 1 << 20), 1 << 23), ((70, 1 << 20), 1 << 23), ((4096, 900), 1 << 23), ((4096, 1 << 20), 40)])
def test_two_fullest_texts_of_each_set(monkeypatch, limit, cells):
    monkeypatch.setattr(blocks, "TEXTS", limit[0])
    monkeypatch.setattr(blocks, "WORDS", limit[1])
    monkeypatch.setattr(blocks, "CELLS", cells)
    draw = random.Random(7)
    texts = [(draw.randrange(400), {draw.randrange(40) for _ in range(draw.randrange(25))}) for _ in range(500)]  # ids repeat
    sets = [set(draw.sample(range(45), draw.randrange(3, 9))) for _ in range(200)]
    known, packed = blocks.packed(pa.chunked_array([pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))]))
    spare = np.array([len(s) - (int(0.7 * len(s) + 1e-9) + 1) for s in sets])
    batches = [pa.record_batch({"id": pa.array([k for k, _ in part], pa.int64()), "words": pa.array([sorted(h) * 2 for _, h in part], pa.list_(pa.int64()))}) for part in (texts[:123], texts[123:])]
    two, seen = blocks.Two(len(sets)), 0
    for block, _ in blocks.blocks(known, iter(batches), {"words": 1.0}):
        found, lacking, text = blocks.fullest(block, packed, spare)
        two.add(found, lacking, block.ids[text])
        seen += len(block.ids)
    got = {i: [(int(n), int(k)) for n, k in zip(two.lacking[i], two.ids[i], strict=True) if n < two.NONE] for i in range(len(sets))}
    assert seen == len(texts)
    assert got == _best(sets, texts, spare)


def test_words_of_texts_are_not_exchanged(spark):
    """Copies of one text and frequent words: a row for each text, and no row for a word of a text or a pair."""
    rows = [(i, "shared words stand before everything written here since then" + (f" tail{i}" if i % 3 else "")) for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, chunk_text string")
    near = lifecycle.near_copies(texts, texts)
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.match_id, r.overlap) for r in near.collect()} == {i: (0 if i else 1, 1.0) for i in range(300)}


def test_many_queries_rank_as_few_do(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda: draw.choice("alpha bravo charlie delta echo foxtrot golf hotel".split())
    chunks = spark.createDataFrame([(i, " ".join(word() for _ in range(draw.randrange(30))) or None, f"{word()}/{i % 4}.md", word()) for i in range(200)], "id long, chunk_text string, source_file string, chunk_type string")
    texts = [" ".join(word() for _ in range(draw.randrange(1, 4))) for _ in range(40)]
    texts += [f"{word()} NOT {word()} {word()}" for _ in range(10)] + [f"{word()} {word()} OR {word()} AND {word()} NOT {word()}" for _ in range(10)] + ["alpha NOT bravo", "alpha bravo", "nowhere alpha", "alpha bravo charlie delta echo foxtrot golf hotel alpha OR x y z alpha bravo charlie delta echo foxtrot golf"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    told = lambda found: sorted((r.query_id, r.base_rank, r.id, round(r.bm25, 9)) for r in found.collect())
    few = told(search.bm25(queries, chunks, limit=6))
    monkeypatch.setattr(search, "FEW", 3)
    many = search.bm25(queries, chunks, limit=6)
    assert told(many) == few
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # texts' terms aren't joined
