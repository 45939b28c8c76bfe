"""Periodic runs against the definition, word by word."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramix.llm import queries, runs
from engramix.llm.work import table


def brute_runs(words):
    """By definition: maximal stretches whose smallest period is q."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    words = [w for w in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = {r[0]: r for r in _rows(queries.op13_periodic_runs(spark, folder))}
    assert len(got) == len(docs)
    short = [d for d in docs if len((d[1] or "").split()) < 900]  # the definition word by word is slow
    assert len(short) > 150 and sum(got[i][1] > 0 for i, _ in short) > 10
    for i, text in short:
        assert got[i] == brute_row(i, text)


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b "),
    (4, "a " * 11),
    (5, "a " * 12),
    (6, "a b " * 40 + "c " + "a b " * 40),
    (7, "x " + "la la la ti " * 9 + "end " + "la la la ti " * 9),
    (8, " ".join(f"w{k % 37}" for k in range(400))),
    (9, " ".join(f"w{k % 20}" for k in range(40)) + " v " + " ".join(f"w{k % 20}" for k in range(39))),
    (None, "no id " * 20),
    (11, "A a " * 10 + "a A " * 10),
    (12, "日本 語 " * 30 + "  x"),
    *((k, " ".join(f"w{(k * j) % (j % 7 + 3)}" for j in range(150))) for k in range(20, 60)),
]


@pytest.mark.parametrize("longest, work", [(runs.LONG, runs.WORK), (20, 100), (0, 1)])
def test_odd_rows_here_and_dealt(spark, longest, work):
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in ODD], "doc_id long, text string, key int, ids string").repartition(3)
    assert _rows(runs.periodic_runs(df, longest=longest, work=work)) == sorted((brute_row(i, t) for i, t in ODD), key=repr)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(4, "b " * 30)] * 3, "doc_id long, text string")
    assert _rows(runs.periodic_runs(df, longest=5)) == [brute_row(4, "b " * 30)] * 3
    assert runs.periodic_runs(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5)), max_size=8))
def test_scan_finds_the_runs_of_the_definition(parts):
    ids = np.array([x for part, times in parts for x in part * times], np.int64)
    assert runs.scan(ids) == brute_runs(ids.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.integers(1, 4)), min_size=1, max_size=6), st.integers(1, 3000))
def test_ranges_of_lags_find_the_same(parts, work):
    ids = np.array([x for part, times in parts for x in part * times], np.int64)
    cut = runs.ranges(len(ids), work)
    assert [q for low, high in cut for q in range(low, high)] == list(range(1, len(ids) // 2 + 1))
    best = {}
    for low, high in cut:
        for s, n, p in runs.scan(ids, low, high):
            best[s, n] = min(p, best.get((s, n), p))
    assert sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2])) == brute_runs(ids.tolist())


def test_long_text_of_one_word_and_of_none_twice():
    assert runs.scan(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.scan(np.arange(200_000)) == []
    twice = np.tile(np.arange(60_000), 2)
    assert runs.scan(twice) == [(0, 120_000, 60_000)]
