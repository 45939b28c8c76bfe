"""Words of whole batches as hashes, and what the searches over blocks leave out."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramix.functions import text
from engramix.operators import blocks, hashes, lifecycle, search

_SPACE = r"[ \t\n\x0b\f\r]+"


@pytest.mark.parametrize("piece", [1 << 18, 7])
@pytest.mark.parametrize("long", [256, 8])
def test_words_are_those_of_a_split(monkeypatch, piece, long):
    monkeypatch.setattr(hashes, "PIECE", piece)
    monkeypatch.setattr(hashes, "LONG", long)
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "B", "b", "é", "\0", "中", "😀", " ", "\t\n", "\x0b"]) for _ in range(draw.randrange(40))) for _ in range(400)]
    texts += ["", " ", "y" * 300, "z" * 70 + " " + "y" * 300]
    for least in (1, 4):
        for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["other", *texts]).slice(1)):
            words, at = hashes.hashed(column, hashes.SPACED, least)
            want = [[w.replace("B", "b") for w in re.split(_SPACE, t) if len(w) >= least] for t in texts]
            assert np.diff(at).tolist() == [len(ws) for ws in want]
            pairs = set(zip((w for ws in want for w in ws), words.tolist(), strict=True))
            assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_places_of_known_words():
    known = np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 1000))
    words = np.concatenate([known[::3], known[::5] + 1, np.array([-(1 << 63), (1 << 63) - 1, 0])])
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    assert hashes.Known(known).find(words).tolist() == np.where(known[at] == words, at, -1).tolist()
    assert hashes.Known(known[:0]).find(words).tolist() == [-1] * len(words)


def test_sets_of_rare_words_are_not_compared_with_all_texts(monkeypatch):
    """Only texts that hold one of the words that decide are looked at."""
    seen = []
    lack = blocks._lack
    monkeypatch.setattr(blocks, "_lack", lambda lacks, absent: (seen.append(absent.size), lack(lacks, absent)))
    texts = [[i * 10 + j for j in range(8)] + [-1, -2] for i in range(2000)]
    batch = pa.record_batch({"id": pa.array(range(2000)), "words": pa.array(texts, pa.list_(pa.int64()))})
    known, sets = blocks.packed(pa.chunked_array([pa.array([t[:7] + [-1] for t in texts], pa.list_(pa.int64()))]))
    order = np.argsort(sets == 1, axis=1, kind="stable")  # the word that all hold comes last
    ((block, _),) = blocks.blocks(known, iter([batch]), {"words": 1.0})
    found, lacking, text = blocks.fullest(block, np.take_along_axis(sets, order, 1), np.full(2000, 2))
    assert found.tolist() == block.ids[text].tolist() == list(range(2000)) and not lacking.any()
    assert not seen


def test_sets_that_are_settled_are_not_looked_at_again(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TEXTS", 50)

    class Sent:
        value = lifecycle._packed(pa.table({"key": [7], "ws": pa.array([hashes.hashed(pa.array(["alpha bravo charlie delta"]), hashes.SPACED)[0].tolist()], pa.list_(pa.int64()))}))

    spares = []
    fullest = blocks.fullest
    monkeypatch.setattr(blocks, "fullest", lambda block, sets, spare: (spares.append(int(spare[0])), fullest(block, sets, spare))[1])
    texts = ["alpha bravo charlie", "nothing"] * 25 + ["alpha bravo charlie delta"] * 100
    batch = pa.record_batch({"id": pa.array(range(150)), "words": pa.array(texts)})
    (rows,) = lifecycle._sharing(Sent, 0.7)(iter([batch]))
    assert rows.to_pydict() == {"key": [7, 7], "match_id": [50, 51], "shared": [4, 4], "n": [4, 4]}
    assert spares == [1, 0, -1]  # two texts lack one word, then two lack none


def test_overlap_of_odd_texts(spark):
    draw = random.Random(9)
    words = ["abcd", "ABCD", "ABÇD", "abçd", "ÉTÉ", "été", "éééé", "İab", "i̇ab", "日本語文", "日本語", "long" * 80, "word", "Word,", "tail", "x" * 5]
    texts = [draw.choice(["", "  ", "é "]) + "".join(draw.choice(words) + draw.choice([" ", "\t", "\n ", "\x0b", "\f", "\r\n"]) for _ in range(draw.randrange(14))) for _ in range(150)] + [None, "short " + "wo " * 400 + "abcd word tail"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, chunk_text string")
    split = [[w for w in re.split(_SPACE, (t or "").lower()) if len(w) > 3] for t in texts]
    want = {}
    for i, own in enumerate(split):
        first = set(own[:8])
        found = [(-len(first & set(other)) / len(first), j) for j, other in enumerate(split) if j != i] if len(first) >= 3 else []
        if found and -min(found)[0] > 0.7:
            want[i] = min(found)[1], round(-min(found)[0], 6)
    assert {r.id: (r.match_id, r.overlap) for r in lifecycle.near_copies(rows, rows).collect()} == want


def test_terms_of_odd_texts(spark):
    draw = random.Random(11)
    texts = ["".join(draw.choice(["a", "Ab", "É", "ç", "ß", "İ", "9", "²", "日本", "😀", "_", "-", " ", "\n", "́", " ", "K"]) for _ in range(draw.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", text.terms(F.col("t")).alias("terms"), text.term_text(F.col("t")).alias("t")).toArrow()
    want = rows["terms"].to_pylist()
    words, at = hashes.hashed(rows["t"].combine_chunks(), hashes.TERMS)
    assert np.diff(at).tolist() == [len(ts) for ts in want]
    pairs = set(zip((t for ts in want for t in ts), words.tolist(), strict=True))
    assert len(pairs) == len({t for t, _ in pairs}) == len({h for _, h in pairs})
    assert hashes.coded(rows["terms"].combine_chunks()).to_pylist() == [words[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("waiting", [1 << 17, 0])
def test_hits_are_sorted_once_for_many_blocks(monkeypatch, waiting):
    monkeypatch.setattr(blocks, "TEXTS", 50)
    monkeypatch.setattr(search, "_WAITING", waiting)
    cuts = []
    first_of = blocks.first_of
    monkeypatch.setattr(blocks, "first_of", lambda *a: (cuts.append(1), first_of(*a))[1])
    draw = random.Random(2)
    names = [f"w{i}" for i in range(12)]
    code = dict(zip(names, hashes.hashed(pa.array(names), hashes.TERMS)[0].tolist(), strict=True))
    texts = [[draw.choice(names) for _ in range(draw.randrange(1, 20))] for _ in range(400)]
    asked = [draw.sample(names, draw.randrange(1, 4)) for _ in range(60)]
    df = {w: sum(w in t for t in texts) for w in names}
    idf = {w: max(1e-6, float(np.log((400 - df[w] + 0.5) / (df[w] + 0.5)))) for w in names}
    avgdl = sum(map(len, texts)) / 400
    gain = lambda w, t: idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
    want = {(i, j) for i, ws in enumerate(asked) for _, j in sorted((-round(sum(gain(w, t) for w in ws), 9), j) for j, t in enumerate(texts) if set(ws) <= set(t))[:6]}
    lists = pa.list_(pa.int64())
    coded = pa.array([[code[w] for w in ws] for ws in asked], lists)

    class Sent:
        value = pa.table({"key": pa.array(range(60)), "ws": coded, "refused": pa.array([[]] * 60, pa.list_(lists)), "tokens": coded, "idfs": pa.array([[idf[w] for w in ws] for ws in asked], pa.list_(pa.float64()))})

    batch = pa.record_batch({"id": pa.array(range(400)), "chunk_text": pa.array([" ".join(t) for t in texts]), "source_file": pa.array([""] * 400), "chunk_type": pa.array([""] * 400)})
    (rows,) = search._scored(Sent, avgdl, 6)(iter([batch]))
    assert set(zip(rows["key"].to_pylist(), rows["id"].to_pylist(), strict=True)) == want
    assert len(cuts) == 1 if waiting else len(cuts) > 1
