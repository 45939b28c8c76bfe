"""Importance resampling against plain Python: every feature hashed by itself."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramix.llm import importance, queries
from engramix.llm.work import table

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _buckets(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_force(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) of distinct ids."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, n in ((docs, s), (target, t)):
        for _, text in texts:
            for b in _buckets(text)[1]:
                n[b] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10_000)]
    rows, able = {}, []
    for i, text in docs:
        words, found = _buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
        if len(words) >= 20:
            able.append(i)
    able.sort(key=lambda i: (-rows[i][2], i is not None, i or 0))
    place = {i: k for k, i in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(((i, *r, place.get(i)) for i, r in rows.items()), key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark, folder):
    got = _rows(queries.op11_importance_resampling(spark, folder))
    docs, target = ([tuple(r) for r in table(spark, folder, name).select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == brute_force(docs, target)
    assert sum(r[-1] is not None for r in got) > 5


def test_odd_rows(spark):
    texts = {
        1: None,
        2: "",
        3: " \n\t--",
        4: "Straße ÉCOLE 10km, the END.",
        5: "x" * 200 + " " + "y" * 64 + " " + "z" * 65,
        6: "日本語" * 50 + " a b " + "日本語" * 50,
        7: " ".join(f"w{k % 23}" for k in range(3000)),
        None: "no id " * 10,
        **{k: f"doc {k} " + " ".join(f"t{j * k % 31}" for j in range(25)) for k in range(10, 60)},
    }
    docs = list(texts.items())
    target = [("a", "t1 t2 t3 the end"), ("b", None), ("c", "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, row string").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in target], "item_id string, text string")
    assert _rows(importance.resample(df, items)) == brute_force(docs, target)


def test_ties_and_repeated_rows(spark):
    same = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(7, same)] * 60, "doc_id long, text string").repartition(3)
    got = importance.resample(df, df)
    assert sorted(r["rank"] for r in got.collect() if r["rank"] is not None) == [1, 2, 3]
    assert got.select("n_features", "weight", "score").distinct().count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c " * 40)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert _rows(importance.resample(some, none)) == brute_force([(1, "a b"), (2, "c " * 40)], [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aZ0é語 -\n", max_size=90), max_size=6))
def test_buckets_of_bytes(texts):
    raw = [t.encode() for t in texts]
    data = importance._LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    starts, lengths, at = importance.words_in(data, offsets)
    found = [[] for _ in texts]
    for lo, blocks in importance.features(data, starts, lengths, np.repeat(at[1:], np.diff(at))):
        for block in blocks:
            for k, b in enumerate(block.tolist()):
                if b >= 0:
                    found[int(np.searchsorted(at, lo + k, side="right")) - 1].append(b)
    assert [sorted(f) for f in found] == [sorted(_buckets(t)[1]) for t in texts]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 300])
def test_long_words_go_on_by_themselves(length):
    data = np.frombuffer(b"q" * length, np.uint8)
    state = importance.advance(np.full(1, 0xFFFFFFFF, np.uint32), data, np.array([0]), np.array([length]))
    assert int(state[0]) ^ 0xFFFFFFFF == zlib.crc32(b"q" * length)


def test_noise_is_of_the_id(spark):
    row = spark.range(3).select("id", importance.noise(F.col("id")).alias("n")).collect()
    assert len({r.n for r in row}) == 3
