import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramix.operators import answers, brief, extract, graph, lifecycle, search, telemetry

NOW = dt.datetime(2026, 1, 15)


def at():
    return F.lit("2026-01-15").cast("timestamp")


def test_thin_keeps_caps(spark):
    rows = [(0, i, f"f{i % 2}", f"text number {i} of many different words {i * i}", "daily", None, 1.0, "fts", i + 1) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, id long, source_file string, chunk_text string, chunk_type string, section string, score double, match_type string, rank int")
    out = search.thin(df, 5).collect()
    assert len(out) == 4 and max(sum(r.source_file == f for r in out) for f in ("f0", "f1")) == 2


def test_thin_drops_near_copies(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(0, 1, "a", t, "x", None, 1.0, "fts", 1), (0, 2, "b", t + " eleven", "y", None, 1.0, "fts", 2), (0, 3, "c", "other words here", "z", None, 1.0, "fts", 3)]
    df = spark.createDataFrame(rows, "query_id long, id long, source_file string, chunk_text string, chunk_type string, section string, score double, match_type string, rank int")
    assert [r.id for r in search.thin(df, 5).orderBy("rank").collect()] == [1, 3]


def test_fusion_ties_keep_order(spark):
    rows = [(0, 0, "fts", 1, 10, "a", "x"), (0, 1, "semantic", 1, 20, "b", "y"), (0, 0, "fts", 2, 30, "c", "z"), (0, 1, "semantic", 2, 30, "c", "z")]
    df = spark.createDataFrame(rows, "query_id long, batch_no int, kind string, rank int, id long, source_file string, chunk_text string")
    out = search.fuse(df, 10).orderBy("rank").collect()
    assert [(r.id, r.match_type) for r in out] == [(30, "hybrid"), (10, "fts"), (20, "semantic")]


def test_entity_count(spark):
    q = spark.createDataFrame([(0, "New York City and York"), (1, "nothing"), (2, None)], "query_id long, query string")
    got = {r.query_id: r.entities for r in search.entity_count(q, ["York", "New York", "city"]).collect()}
    assert got == {0: 3, 1: 0, 2: 0}
    plain = spark.createDataFrame([(0, 'MyThing and "a b" and Other')], "query_id long, query string")
    assert search.entity_count(plain, []).first().entities == 2


def test_rerank_fails_open(spark):
    rows = spark.createDataFrame([(0, "q", i, f"t{i}", i + 1) for i in range(5)], "query_id long, query string, id long, chunk_text string, rank int")

    def broken(queries, texts):
        raise OSError("no service")

    assert [r.id for r in search.rerank(rows, broken, k_out=3).orderBy("new_rank").collect()] == [0, 1, 2]
    best = search.rerank(rows, lambda q, t: [int(x[1:]) for x in t], k_out=2).orderBy("new_rank").collect()
    assert [r.id for r in best] == [4, 3]


def bfs(edges, start, end, most):
    paths = {start: [start]}
    for depth in range(most + 1):
        if end in paths:
            return depth
        new = {}
        for u, p in paths.items():
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == u and y not in paths:
                        new[y] = p + [y]
        paths = paths | new
    return None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=12))
def test_paths_match_bfs(spark, edges):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id long, source_id long, target_id long")
    got = graph.shortest_path(df, 0, 5).collect()
    want = bfs(edges, 0, 5, 4)
    assert [r.depth for r in got] == ([] if want is None else [want])
    for r in got:
        assert r.path[0] == 0 and r.path[-1] == 5 and all((a, b) in edges or (b, a) in edges for a, b in zip(r.path, r.path[1:], strict=False))


def test_decay_is_idempotent(spark):
    rows = [(1, 0.9, NOW - dt.timedelta(days=95), NOW + dt.timedelta(days=5)), (2, 0.9, NOW, None), (3, 0.9, NOW, NOW - dt.timedelta(days=1)), (4, 0.35, NOW - dt.timedelta(days=40), None)]
    df = spark.createDataFrame(rows, "id long, confidence double, last_confirmed timestamp, expires_at timestamp")
    got = {r.id: (r.confidence_after, r.expires_after) for r in graph.decayed(df, at()).collect()}
    assert set(got) == {1, 2, 4} and got[1][0] == 0.6 and got[4] == (0.25, NOW + dt.timedelta(days=7)) and got[2] == (0.9, None)


def test_merge_and_rename(spark):
    e = spark.createDataFrame([(1, "Ann", "person", 1), (2, "ann ", "person", 5), (3, "ann", "project", 9)], "id long, name string, entity_type string, mention_count long")
    assert {(r.id, r.canonical_id) for r in graph.merged(e).collect()} == {(1, 2), (2, 2), (3, 3)}
    c = spark.createDataFrame([(1, "see old-slug, not old-slug-2")], "id long, chunk_text string")
    assert graph.renamed(c, "old-slug", "new").first().chunk_text == "see new, not old-slug-2"
    r = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "old string, new string")
    assert {x.start for x in graph.rename_cycles(r).collect()} == {"a", "b"}


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_rings_of_renames_of_any_length(spark, n):
    ring = [(f"s{i}", f"s{(i + 1) % n}") for i in range(n)]
    lead = [(f"l{i}", f"l{i + 1}" if i < 30 else "s0") for i in range(31)] + [(f"e{i}", f"e{i + 1}") for i in range(40)]
    r = spark.createDataFrame([*ring, *lead, (None, "s0"), ("z", None)], "old string, new string")
    assert {x.start for x in graph.rename_cycles(r).collect()} == {old for old, _ in ring}


def test_the_last_rename_of_a_slug_counts(spark):
    r = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 2)], "old string, new string, at int")
    assert graph.rename_cycles(r, "at").count() == 0 and graph.rename_cycles(r.filter("at = 1"), "at").count() == 2


def test_path_between_names(spark):
    e = spark.createDataFrame([(1, "Ann Lee"), (2, "store"), (3, "Bob"), (4, "bobby")], "id long, name string")
    r = spark.createDataFrame([(1, 1, "uses", 2), (2, 3, "runs", 2), (3, 3, "owns", 2)], "id long, source_id long, relation_type string, target_id long")
    got = graph.named_path(e, r, "ann", "BOB").orderBy("step").collect()
    assert [(x.id, x.entity, x.relation) for x in got] == [(1, "Ann Lee", "START"), (2, "store", "uses"), (3, "Bob", "owns")]
    assert graph.named_path(e, r, "ann", "nobody").count() == 0 and graph.named_path(e, r, "ann", "bobby").count() == 0
    edges = graph.adjacency(r)
    assert graph.named_path(e, r, "ann", "bob", edges=edges).count() == 3


def ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_merge_candidates_match_all_pairs(spark, least):
    rng = random.Random(5)
    names = ["kubernetes", "cubernetes", "book", "notebook", "Notebook", "a", "ab", "x" * 40, "x" * 41, "", "--"]
    for _ in range(70):
        base = list(rng.choice(names) if rng.random() < 0.6 else "".join(rng.choices("abc ", k=rng.randint(1, 30))))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(base))
            base[at : at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 2))
        names.append("".join(base))
    rows = [(i, n, "tu"[i % 7 == 0], 1) for i, n in enumerate(names)]
    key = lambda n: " ".join(re.findall("[a-z0-9]+", n.lower()))
    want = {}
    for i, n, t, _ in rows:
        for j, m, u, _ in rows[:i]:
            x, y = key(n), key(m)
            if x and y and t == u and (rule := "normalized" if x == y else "substring" if x in y or y in x else "similar" if ratio(x, y) >= least else None):
                want[j, i] = rule
    entities = spark.createDataFrame(rows, "id long, name string, entity_type string, mention_count long")
    got = graph.merge_candidates(entities, spark.createDataFrame([], "entity_id long, chunk_id long"), least).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.rule for r in got} == want


def test_protected_names_are_a_risk(spark):
    e = spark.createDataFrame([(1, "Atlas", "p", 1), (2, "atlas", "p", 90), (3, "Other", "p", 1), (4, "other", "p", 1)], "id long, name string, entity_type string, mention_count long")
    got = graph.merge_candidates(e, spark.createDataFrame([(1, 7), (2, 7)], "entity_id long, chunk_id long"), protected=["Atlas"]).collect()
    assert {(r.a, r.b, r.shared, r.risk) for r in got} == {(1, 2, 1, "protected"), (3, 4, 0, "low")}


def test_cached_answers_by_cosine(spark):
    """Of equal cosines the greatest response; unlike sizes and vectors with nulls don't meet; all questions of one file are dealt out."""
    cache = spark.createDataFrame([("h1", "a", [1.0, 0.0]), ("h2", "b", [2.0, 0.0]), ("h3", "c", [0.0, 1.0]), ("h4", "z", [1.0, 0.0, 0.0]), ("h5", "y", [1.0, None]), ("h6", "n", [0.0, 0.0])], "query_hash string, response string, cached_embedding array<double>")
    cache = cache.withColumns({"created_at": at(), "ttl_hours": F.lit(24)})
    asked = spark.createDataFrame([(1, "q", [5.0, 0.1]), (2, "h3", [1.0, 0.0]), (3, "q", [-1.0, -1.0]), (4, "q", None), (5, "q", [None, 1.0]), (6, "q", [0.0, 0.0, 2.0]), (7, "q", [3.0, 0.0, 0.0])], "query_id long, query_hash string, embedding array<double>").coalesce(1)
    found = answers.cached(asked, cache, at(), 0.5)
    assert {(r.query_id, r.hit, r.response) for r in found.collect()} == {(1, "semantic", "b"), (2, "exact", "c"), (7, "semantic", "z")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "zip_with" not in plan and "Repartition" in plan


def test_names_of_all_types_are_sought_together(spark):
    c = spark.createDataFrame([(1, "a thathing", "x", None), (2, "That thing, THAT", "x", None), (3, "the thing", "x", None)], "id long, chunk_text string, chunk_type string, source_date date")
    got = {(r.chunk_id, r.name, r.entity_type) for r in graph.mentions(c, {"person": ["that"], "project": ["thing"], "agent": ["That"], "none": []}).collect()}
    assert got == {(1, "that", "person"), (1, "that", "agent"), (2, "that", "person"), (2, "that", "agent"), (2, "thing", "project"), (3, "thing", "project")}


def test_candidates_are_counted_without_pairs(spark):
    """Three names with many bearers: counts by classes are those of the pairs, and no plan exchanges the pairs."""
    e = spark.createDataFrame([(i, ("old rod", "cold rod", "Old  Rod!", "blue bolt", "")[i % 5], "tu"[i % 7 == 0], None if i % 11 == 0 else i % 19) for i in range(400)], "id long, name string, entity_type string, mention_count long")
    evidence = spark.createDataFrame([(i, i // 7 % 25) for i in range(400)] * 2, "entity_id long, chunk_id long")
    pairs = graph.merge_candidates(e, evidence, protected=["Blue Bolt"])
    rows = pairs.collect()
    chunk = {i: i // 7 % 25 for i in range(400)}
    assert len({(r.a, r.b) for r in rows}) == len(rows) > 10_000 and all(r.shared == (chunk[r.a] == chunk[r.b]) for r in rows)
    want = {}
    for r in rows:
        want[r.rule, r.risk] = want.get((r.rule, r.risk), 0) + 1
    assert {(r.rule, r.risk): r.n for r in graph.candidate_counts(e, evidence, protected=["Blue Bolt"]).collect()} == want and len(want) > 4
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "a_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line and "b_mention_count" in line)


def test_near_copies_by_cosine(spark):
    # 1 has a like vector but few of 10's words; 2 has its words but another vector; 3 has no vector; 4 is short; 5 isn't like 14
    new = [(1, "alpha beta"), (2, "gamma delta words here"), (3, "third long words without vector"), (4, "tiny"), (5, "nothing alike here")]
    old = [(10, "alpha beta and many other things said in another way"), (12, "gamma delta words here"), (13, "third long words without vector"), (14, "tiny bit"), (15, "tiny without vector")]
    schema = "id long, source_file string, chunk_text string, chunk_type string"
    rows = lambda r: spark.createDataFrame([(i, "f", t, "x") for i, t in r], schema)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (10, [0.9, 0.1]), (2, [1.0, 0.0]), (12, [0.0, 1.0]), (4, [0.0, 2.0]), (14, [0.0, 1.0]), (5, [1.0, 0.0])], "id long, embedding array<double>")
    got = {(r.id, r.match_id, r.cosine, r.overlap) for r in lifecycle.near_copies(rows(new), rows(new + old), vectors=vectors).collect()}
    assert got == {(1, 10, 0.993884, None), (3, 13, None, 1.0), (4, 14, 1.0, None)}
    assert {(r.id, r.match_id) for r in lifecycle.near_copies(rows(new), rows(old)).collect()} == {(2, 12), (3, 13)}


def test_churn_searches_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "PASS_BYTES", 700)
    rng = np.random.default_rng(3)
    e = rng.normal(size=(90, 8))
    e[40:60] = e[:20]  # equal vectors, with other labels
    e[70:80] = e[0]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    when = [dt.datetime(2026, 1, 10) if i % 3 == 0 else dt.datetime(2025, 1, 1) for i in range(90)]
    chunks = spark.createDataFrame([(i, f"f{i}", "x", when[i]) for i in range(90)], "id long, source_file string, chunk_type string, created_at timestamp")
    vectors = spark.createDataFrame([(i, [float(v) for v in e[i]], i % 4 + i // 40) for i in range(90)] + [(95, None, 0)], "id long, embedding array<double>, label int")
    want = {}
    for i in range(0, 90, 3):
        s = 1 - ((e - e[i]) ** 2).sum(1) / 2
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[j], 9), j))[:6]
        if older := [j for j in order if when[j] < dt.datetime(2026, 1, 1) and s[j] >= 0.3]:
            want[i] = (older[0], round(s[older[0]], 6), bool(s[older[0]] >= 0.995))
    got = {r.new_id: (r.old_id, r.similarity, r.exact) for r in search.churn(chunks, vectors, F.lit("2026-01-01").cast("date"), 5, 0.3).collect()}
    assert got == want and any(x[2] for x in want.values())


def test_affected(spark):
    e = spark.createDataFrame([(1, "Big Thing", "project", 1), (2, "x", "person", 1), (3, "y", "person", 1)], "id long, name string, entity_type string, mention_count long")
    r = spark.createDataFrame([(7, 2, 3)], "id long, source_id long, target_id long")
    ev = spark.createDataFrame([(7, "notes/a.md")], "relation_id long, source_file string")
    ch = spark.createDataFrame([("memory/entities/projects/big-thing.md",), ("notes/a.md",)], "source_file string")
    assert {x.id for x in graph.affected(ch, e, r, ev).collect()} == {1, 2, 3}


def test_retier_can_rise_twice(spark):
    schema = "id long, tier string, access_count int, created_at timestamp, last_accessed_at timestamp, retention_days int"
    rows = [(1, "peripheral", 12, NOW, NOW, 90), (2, "working", 0, NOW - dt.timedelta(days=31), None, 90), (3, "core", 1, NOW, None, None), (4, "peripheral", None, NOW, None, 90)]
    got = {r.id: (r.tier_after, r.retention_after) for r in lifecycle.retier(spark.createDataFrame(rows, schema), at()).collect()}
    assert got == {1: ("core", None), 2: ("peripheral", 90), 3: ("working", None), 4: ("peripheral", 90)}


def test_merge_reread_and_guard(spark):
    schema = "id long, source_file string, chunk_text string, tier string, access_count int"
    old = spark.createDataFrame([(1, "a", "x", "core", 9), (2, "a", "gone", "working", 1), (3, "other", "z", "core", 1)], schema)
    new = spark.createDataFrame([(10, "a", "x", "peripheral", 0), (11, "a", "new", "peripheral", 0)], schema)
    m = lifecycle.merge_reread(old, new)
    assert {(r.action, r.tier, r.access_count) for r in m.collect()} == {("kept", "core", 9), ("removed", "working", 1), ("added", "peripheral", 0)}
    with pytest.raises(lifecycle.WipeGuard):
        lifecycle.guard(lifecycle.merge_reread(old, new.filter("id = 10")), 0.9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40))
def test_ranked_value(spark, values):
    df = spark.createDataFrame([("c", "success", float(v), NOW - dt.timedelta(hours=1)) for v in values], "command string, status string, duration_ms double, ts timestamp")
    got = telemetry.command_stats(df, F.timestamp_add("DAY", F.lit(-1), at()), at()).first().p95_ms
    n, s = len(values), sorted(values)
    assert got == (s[-1] if n < 20 else s[-(-95 * n // 100) - 1])


def test_proposals(spark):
    rows = [("slow", "success", 10.0, NOW - dt.timedelta(days=10)), ("slow", "success", 50.0, NOW - dt.timedelta(days=1)), ("new", "success", 1.0, NOW - dt.timedelta(days=1))]
    rows += [("old", "success", 1.0, NOW - dt.timedelta(days=65))] * 3
    df = spark.createDataFrame(rows, "command string, status string, duration_ms double, ts timestamp")
    got = {(r.command, r.rule, r.level) for r in telemetry.proposals(df, at()).collect()}
    assert {("slow", "slower", "alert"), ("new", "first_use", "info"), ("old", "dormant", "warn")} <= got


BRIEF = "id long, source_file string, chunk_text string, chunk_type string, source_date date, created_at timestamp, last_accessed_at timestamp, access_count int, importance double, pain double, retention_days int"


def told(i, text, where="memory", importance=0.5, pain=0.2, age=40):
    return i, f"{where}/p{i}.md", text, "decision", dt.date(2026, 1, 15) - dt.timedelta(days=age), NOW, None, i, importance, pain, None


def briefed(spark, rows, served, **options):
    chunks = spark.createDataFrame(rows, BRIEF)
    log = spark.createDataFrame([(i, NOW) for i in served], "chunk_id long, served_at timestamp")
    out = brief.build(chunks, log, at(), "memory", **options).collect()
    return sorted((r for r in out if r.place is not None), key=lambda r: r.place), [r for r in out if r.place is None]


def test_brief(spark):
    rows = [told(1, "same line of text here"), told(2, "same line of text here with more"), told(3, "another very different thing"), told(4, "scope only content words", pain=0.95)]
    now, _ = briefed(spark, rows, [3], n=4)
    assert {r.id for r in now} == {4, 3, 2} and len({r.line for r in now}) == 3  # 1 is a near copy of 2, which is read more
    empty, left = briefed(spark, [], [], n=4)
    assert empty == [] == left


def test_brief_shares_its_rows_between_agent_and_scope(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima".split()
    rows = [told(i, f"{words[i]} {words[i]}s {words[i]}ing", "sessions/bot" if i < 2 else "memory", importance=0.3 if i < 2 else 0.9) for i in range(12)]
    now, _ = briefed(spark, rows, [], agent="bot", n=4)
    assert {r.id for r in now} >= {0, 1} and len(now) == 4  # half for the agent, however low its score
    now, _ = briefed(spark, rows, [], agent="nobody", n=4)
    assert len(now) == 4 and not {r.id for r in now} & {0, 1}  # what one pool lacks the other fills
    now, _ = briefed(spark, rows[:3], [], n=10)
    assert {r.id for r in now} == {2}


def test_brief_has_fresh_rows_and_keeps_pain(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima".split()
    rows = [told(i, f"{words[i]} {words[i]}s {words[i]}ing", importance=0.95) for i in range(6)]
    rows += [told(6, "grave outage of everything", importance=0.6, pain=0.95), told(7, "recent weighty lesson", importance=0.71, age=2), told(8, "recent served lesson twice", importance=0.72, age=1), told(9, "recent light remark", importance=0.1, age=0)]
    now, left = briefed(spark, rows, [8, *[0] * 50], n=5)
    by = {r.id: r for r in now}
    assert by[7].fresh and by[7].change == "would_enter" and 8 not in by and 9 not in by
    plain = [r.id for r in briefed(spark, rows, [], n=5, slots=0)[0]]
    assert {r.id for r in left} == set(plain) - set(by)
    many, _ = briefed(spark, [*rows, *[told(20 + i, f"{w} hurts {w}ly {w}ed", pain=0.99, importance=0.99) for i, w in enumerate(words[:5])]], [], n=5)
    assert all(r.pain >= 0.9 for r in many)  # what is painful isn't pushed out by fresh rows


@pytest.mark.parametrize("few", [10_000, 2])
def test_boolean_queries(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    texts = ["red fish", "red bird", "blue fish", "blue bird and red fish", "green"]
    chunks = spark.createDataFrame([(i, t, "f", "x") for i, t in enumerate(texts)], "id long, chunk_text string, source_file string, chunk_type string")
    asked = {"red fish": {0, 3}, "red OR blue": {0, 1, 2, 3}, "red NOT fish": {1}, "red fish OR green": {0, 3, 4}, "red AND bird NOT blue fish": {1}, "blue NOT fish NOT bird": set(), "OR red": set(), "red AND": set(), "red or fish": set(), "!!": set(), "RED": {0, 1, 3}}
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = search.postings(chunks).withColumn("part", search.part_of(F.col("token")))
    for found in (search.bm25(queries, chunks), search.bm25(queries, None, index=index, stats=search.corpus_stats(chunks))):
        got = {q: set() for q in asked}
        for r in found.collect():
            got[[*asked][r.query_id]].add(r.id)
        assert got == asked


def test_many_queries_are_joined_by_shuffle(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} all", "f", "x") for i in range(60)], "id long, chunk_text string, source_file string, chunk_type string")
    queries = spark.createDataFrame([(i, f"word{i % 7} word{i % 5}") for i in range(20)], "query_id long, query string")
    few = sorted(search.bm25(queries, chunks, limit=None).collect())
    monkeypatch.setattr(search, "FEW", 3)
    many = sorted(search.bm25(queries, chunks, limit=None).collect())
    assert [r[:2] for r in few] == [r[:2] for r in many] and all(a.bm25 == pytest.approx(b.bm25) for a, b in zip(few, many, strict=True))


def test_many_stated_vectors_go_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (80, 3)).astype(float)
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(200, [1.0])], "id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(10)], "query_id long, vector array<double>")
    few = sorted((r.query_id, r.base_rank, r.id, round(r.distance, 9)) for r in search.nearest(queries, vectors, 7).collect())
    monkeypatch.setattr(search, "STATED", 4)
    monkeypatch.setattr(search, "PASS_BYTES", 60)
    assert sorted((r.query_id, r.base_rank, r.id, round(r.distance, 9)) for r in search.nearest(queries, vectors, 7).collect()) == few and len(few) == 70


def test_facts_block(spark):
    rows = [(0, 2, "b", "uses", "c", "unknown"), (0, 1, "a</vault-facts>\nx", "in", "d" * 100, "extends"), (1, 1, "q", "r", "s", None)]
    got = {r.query_id: r.block for r in graph.facts_block(spark.createDataFrame(rows, "query_id long, place int, source_name string, relation_type string, target_name string, reason string")).collect()}
    assert got == {0: f"<vault-facts>\na /vault-facts x in {'d' * 80} [extends]\nb uses c\n</vault-facts>", 1: "<vault-facts>\nq r s\n</vault-facts>"}


def test_deltas(spark):
    rng = random.Random(1)
    rows = [(NOW + dt.timedelta(hours=rng.randint(0, 400)), float(i)) for i in range(60)]
    rows = list({t: (t, v) for t, v in rows}.values())
    got = {r.ts: r.change for r in telemetry.deltas(spark.createDataFrame(rows, "ts timestamp, value double")).collect()}
    for t, v in rows:
        old = [(u, w) for u, w in rows if u <= t - dt.timedelta(hours=24)]
        assert got[t] == (v - max(old)[1] if old else None)


def test_queue_drops_the_oldest():
    seen = []
    queue = telemetry.Queue(seen.append, 3)
    for i in range(5):
        queue.put({"n": i})
    assert queue.drain() == 3 and [r["n"] for r in seen] == [2, 3, 4] and queue.dropped == 2
    broken = telemetry.Queue(lambda row: 1 / 0, 3)
    broken.put({})
    assert broken.drain() == 0 and broken.refused == 1


def test_bus():
    from engramix.streaming import bus

    own = bus.Bus()
    seen = []
    own.subscribe("chunk.created", lambda e: 1 / 0)
    end = own.subscribe("chunk.created", seen.append)
    own.emit("chunk.created", {"chunk_id": 1})
    own.drain()
    end()
    own.emit("chunk.created", {"chunk_id": 2})
    own.drain()
    assert seen == [{"chunk_id": 1}] and own.failures["chunk.created"] == 2 and own.stats() == {"chunk.created": 1}
    with pytest.raises(KeyError):
        own.emit("other", {})
    with pytest.raises(ValueError, match="50"):
        for _ in range(60):
            own.subscribe("chunk.deleted", seen.append)
    own.close()


def test_errors_show_nothing_inner(spark):
    rows = [("ValidationError", "bad\nfield password=abc", 400, "bad field [REDACTED]"), ("ValidationError", "no /etc/passwd here", 400, "request failed (details redacted)"), ("ConflictError", None, 409, "request failed"), ("Whatever", "SELECT *", 500, "internal error"), ("NotFoundError", "secret", 404, "resource not found"), ("ConflictError", "x" * 300, 409, "x" * 200 + "…"), (None, "x", 500, "internal error"), ("ConflictError", r"at C:\\tmp\\a", 409, "request failed (details redacted)")]
    df = spark.createDataFrame([r[:2] for r in rows], "kind string, message string")
    got = [(r.e.status, r.e.error) for r in df.select(extract.public_error(F.col("kind"), F.col("message")).alias("e")).collect()]
    assert got == [r[2:] for r in rows]


def test_reflection(spark):
    schema = "query_hash string, query string, response string, evidence_sources string, model string, created_at timestamp, ttl_hours int, cached_embedding array<float>"
    cache = spark.createDataFrame([], schema)
    asked = []

    def gather(question):
        asked.append(question)
        return answers.Evidence([("text", "a.md", 1.0)], [("Ann", "person", ["in -> x"])], [("k", "c")], ["Ann -> x"])

    first = answers.reflect("What of Ann?", cache, gather, lambda p: " she is in x " if "Ann (person) rels: in -> x" in p else "", at(), [1.0, 0.0])
    assert first["answer"] == "she is in x" and first["evidence_count"] == 3 and first["sources"] == ["a.md"]
    cache = answers.remembered(cache, first["entry"], "m", at())
    cache = answers.remembered(cache, first["entry"], "m", at())
    assert cache.count() == 1
    again = answers.reflect("What of Ann?", cache, gather, lambda p: 1 / 0, at())
    near = answers.reflect("What about Ann?", cache, gather, lambda p: 1 / 0, at(), [0.99, 0.05])
    assert (again["cached"], near["cached"], near["answer"], asked) == ("exact", "semantic", "she is in x", ["What of Ann?"])
    late = answers.reflect("What of Ann?", cache, gather, lambda p: 1 / 0, F.timestamp_add("HOUR", F.lit(30), at()))
    assert late["cached"] is None and late["answer"].startswith("[reflect error")
    assert answers.reflect("What of Ann?", cache, gather, lambda p: "", at(), use_cache=False)["answer"] == "[reflect: empty response]"
    assert answers.names_in("When did Ann meet Bob-Joe, in Rome?") == ["When", "Ann", "Bob-Joe", "Rome"]
    assert len(answers.Evidence([("x" * 300, "s", 1.0)] * 9, [], [], ["p" * 3000]).text()) == 2000 + len("\n[truncated]")


def test_answers(spark):
    hits = spark.createDataFrame([(0, 1, "alpha", 2.0, "h"), (0, 2, "alpha", 1.0, "h"), (0, 3, "beta", 0.5, None)], "query_id long, id long, content string, score double, content_hash string")
    said = answers.answer("q", hits, lambda p: "It is [chunk_1] and [chunk_2].")
    assert said["ok"] and said["citations"] == [1, 3]
    assert answers.answer("q", hits, lambda p: "[chunk_9]")["failed_reason"] == "hallucinated_citation"
    assert answers.answer("q", hits.limit(0), lambda p: 1 / 0)["answer"] == answers.EMPTY


def refuse(prompt):
    raise PermissionError


def test_chain():
    clock = [0.0]
    calls = []

    def bad(p):
        calls.append("bad")
        raise TimeoutError

    chain = answers.Chain([("bad", bad), ("good", lambda p: "yes")], lambda: clock[0])
    assert chain("x") == "yes" and chain("x") == "yes" and calls == ["bad"]
    clock[0] = 61
    assert chain("x") == "yes" and calls == ["bad", "bad"]
    slow = answers.Chain([("slow", lambda p: time.sleep(1)), ("good", lambda p: "yes")], lambda: 0.0, timeout=0.05)
    assert slow("x") == "yes" and "slow" in slow.resting
    with pytest.raises(PermissionError):
        answers.Chain([("shut", refuse), ("good", lambda p: "yes")], lambda: 0.0)("x")
