"""Each corpus operator against brute force, and its defined results for odd input."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramix.llm import bestfit, chat_format, components, decontaminate, html_text, kernel, language, ngram_jaccard, packing, quality, tokens, topk, url_lists, work

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \t\n", "one", "x" * 300_000, "a b c d e " * 20_000, "é   😀 \x00 z", "same same same same same same", "same same same same same same"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- kernels ---------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb \t\n\x0b\x85éZ-9", max_size=30), max_size=8))
def test_word_hashes_are_words(texts):
    for kind, pattern in ((kernel.SPACED, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, at = kernel.hash_words([t.encode() for t in texts], kind)
        words = [re.findall(pattern, lower(t)) for t in texts]
        assert np.diff(at).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(h.tolist())) == len(set(flat)) == len({*zip(flat, h.tolist(), strict=True)})


def test_words_over_segments():
    long = b"q" * 70_000
    h, at = kernel.hash_words([b"x " * 32_000 + long, long, b"x"], kernel.SPACED)
    assert h[at[1] - 1] == h[at[1]] and h[0] == h[at[2]] and len(set(h.tolist())) == 2


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 90) + str(rng.randrange(50)) for _ in range(200)).encode(), b"", b"z" * 500, b" " * 300, b"tail " + b"y" * 150]
    for kind in (kernel.SPACED, kernel.ALNUM):
        whole = kernel.hash_words(texts, kind)
        monkeypatch.setattr(kernel, "_MOST", 100)
        cut = kernel.hash_words(texts, kind)
        monkeypatch.undo()
        assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


# --- 2: near duplicates ----------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def families(seed, n=120):
    rng = random.Random(seed)
    shared = " ".join(rng.choices(WORDS, k=60))
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and out:
            base = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(WORDS) + str(rng.randrange(9))
            out.append(" ".join(base))
        elif kind < 0.7:
            out.append(shared + " " + " ".join(w + str(rng.randrange(50)) for w in rng.choices(WORDS, k=rng.randint(5, 60))))
        else:
            out.append(" ".join(w + str(rng.randrange(50)) for w in rng.choices(WORDS, k=rng.randint(1, 120))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = families(seed)
    sizes, roots = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, roots, strict=True))


def brute_sets(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ()) for w in words]


def test_whole_join_matches_brute_force(spark):
    texts = families(4, 90)
    sets = brute_sets(texts)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    want = {(first[a], first[b], len(a & b), len(a | b)) for a in first for b in first if first[a] < first[b] and a & b and 100 * len(a & b) >= 80 * len(a | b)}
    docs = docs_of(spark, texts)
    assert {tuple(r) for r in ngram_jaccard.similar_pairs(docs).collect()} == want and len(want) > 10
    links = {i: sum(j != i and bool(s & t) and 100 * len(s & t) >= 80 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)}
    assert {r.doc_id: (r.n_shingles, r.class_id, r.n_links) for r in ngram_jaccard.linked(docs).collect()} == {i: (len(s), first[s], links[i]) for i, s in enumerate(sets)}


def test_whole_join_of_odd_rows(spark):
    text = " ".join(WORDS)
    docs = docs_of(spark, [text, text, text + " end", None, "", text, "one"], [3, 2, 9, 4, 4, None, 5]).withColumns({"a": F.lit(1), "rep": F.lit("x")})
    n, m = len(WORDS) - 4, len(WORDS) - 3
    assert [tuple(r) for r in ngram_jaccard.similar_pairs(docs).collect()] == [(2, 9, n, m)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.class_id, r.n_links) for r in ngram_jaccard.linked(docs).collect()), key=str)
    assert got == sorted([(3, n, 2, 2), (2, n, 2, 2), (9, m, 9, 2), (4, 0, 4, 0), (4, 0, 4, 0), (0, n, None, None), (5, 1, 5, 0)], key=str)
    assert ngram_jaccard.similar_pairs(docs.limit(0)).count() == ngram_jaccard.linked(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(WORDS)
    near = text + " end"
    other = " ".join(reversed(WORDS))
    keep = lambda rows: sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in ngram_jaccard.keep_one(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()), key=str)
    want = lambda rows: sorted(((i is not None, i or 0, t) for i, t in rows), key=str)
    assert keep([(1, text), (1, text), (2, text)]) == want([(1, text)])
    assert keep([(2, text), (1, near), (2, near), (3, other)]) == want([(1, near), (3, other)])
    assert keep([(7, text), (7, other), (7, other), (8, near), (8, "else"), (9, "else")]) == want([(7, text), (7, other), (8, "else")])
    assert keep([(5, text), (20, text), (20, other), (21, other)]) == want([(5, text), (20, other)])
    assert keep([(5, text), (5, near), (6, near)]) == want([(5, text)])
    assert keep([(None, text), (None, text), (4, text), (4, text)]) == want([(None, text), (None, text), (4, text)])
    assert keep([(5, None), (5, ""), (6, ""), (6, " "), (9, None), (9, text)])[0][1] == 5 and len(keep([(5, None), (5, ""), (6, ""), (6, " "), (9, None), (9, text)])) == 4
    assert keep([]) == []
    clash = docs_of(spark, [text, text], [1, 1]).withColumns({"doc": F.lit(1), "row": F.lit(2), "component_id": F.lit(3), "m": F.create_map(F.lit(1), F.lit(2))})
    assert [r.asDict() for r in ngram_jaccard.keep_one(clash).collect()] == [clash.first().asDict()]


def test_near_duplicates_odd_input(spark):
    ids = [*range(len(ODD))]
    extra = docs_of(spark, ODD, ids).withColumns({"gid": F.lit(1), "token": F.lit("x"), "rep": F.lit(None), "doc": F.lit(3)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(extra).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[8] == (got[7][0], 7)
    with_null = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [5, None, 3])
    assert sorted((r.doc_id or -1, r.component_id) for r in ngram_jaccard.near_duplicates(with_null).collect()) == [(-1, None), (3, 3), (5, 3)]
    assert ngram_jaccard.near_duplicates(docs_of(spark, [])).count() == 0
    again = docs_of(spark, ["a b c d e f", "u v w x y z", "u v w x y z"], [1, 1, 2])  # one id, two texts
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard.near_duplicates(again).collect()} == {(1, 1), (2, 1)}


def test_null_id_before_a_near_copy(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = "other " + text  # another prefix or size, so the two meet in the join only
    docs = docs_of(spark, [text, text, near], [None, 5, 7]).coalesce(1)
    assert sorted((r.doc_id or -1, r.component_id) for r in ngram_jaccard.near_duplicates(docs).collect()) == [(-1, None), (5, 5), (7, 5)]
    assert sorted(r.doc_id or -1 for r in ngram_jaccard.keep_one(docs).collect()) == [-1, 5]


def test_one_of_each_group_stays(spark):
    texts = families(3, 60)
    _, roots = brute_components(texts)
    kept = ngram_jaccard.keep_one(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert all(got[i] == 10 for i in range(10, 61)) and got[101] == 100 and got[100] == 100


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3)
    bitmap = work.id_filter(ids.select("id"))
    hit = spark.range(3000).filter(work.passes(spark, bitmap, F.col("id")))
    assert ids.join(hit, "id", "left_anti").count() == 0 and hit.count() < 1010


# --- 7: decontamination ----------------------------------------------------------------------------------------------


def brute_contamination(texts, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for name, t in items:
        w = pattern.findall(lower(t))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(name))
    out = []
    for t in texts:
        w, hit, names = pattern.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def leaky(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2, 9, 10, 11, 40])))) for i in range(12)] + [(3, " ".join(WORDS)), (13, None)]
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 200))) for _ in range(30)]
    for i in range(0, 30, 3):
        texts[i] += ". " + (rng.choice(items)[1] or "").upper() + "; " + rng.choice(WORDS)
    return texts, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination_matches_brute_force(spark, seed, monkeypatch):
    texts, items = leaky(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    ask = lambda: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    want = dict(enumerate(brute_contamination(texts, items)))
    assert ask() == want
    monkeypatch.setattr(decontaminate, "BENCH_BYTES", 500)  # a benchmark too large for one pass
    assert ask() == want
    clean = decontaminate.clean(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in want.items() if not w[4]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=6), st.lists(st.sampled_from("abc"), min_size=1, max_size=20))
def test_longest_match(texts, item):
    shard = decontaminate.Shard([" ".join(t).encode() for t in texts], len(item))
    items = decontaminate.Items.of([("i", " ".join(item))])
    flat = [tuple(t) for t in texts]
    got = dict.fromkeys(range(len(item)), 0)
    search = decontaminate.Search(shard, items)
    for at in search.blocks(np.ones(len(items.words), np.int64)):
        length, place = search.longest(at)
        for a, n, p in zip(at.tolist(), length.tolist(), place.tolist(), strict=True):
            got[a] = n
            if n:
                d = int(shard.doc[p])
                begin = p - int(shard.doc_begin[d])
                assert flat[d][begin : begin + n] == tuple(item[a : a + n])
    for a in range(len(item)):
        best = max((n for n in range(len(item) - a + 1) for t in flat for i in range(len(t)) if n and t[i : i + n] == tuple(item[a : a + n])), default=0)
        assert got[a] == best


def test_cost_does_not_grow_with_the_longest_item():
    rng = random.Random(1)
    item = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    items = decontaminate.Items.of([("a", " ".join(item)), ("b", "a b c d e f g h i j")])
    shard = decontaminate.Shard([" ".join(item[50_000:170_000]).encode(), b"q a b c d e f g h i j q"], items.depth())
    search = decontaminate.Search(shard, items)
    at = np.concatenate([*search.blocks(np.full(len(items.words), 10))])
    length, place = search.longest(at)
    assert length.max() == 120_000 and place[length.argmax()] == 0 and length[at == 200_000].tolist() == [10]
    _, n_hit, names = decontaminate._per_doc(shard, items, 10)
    assert n_hit.tolist() == [120_000, 10] and names == {0: ["a"], 1: ["b"]}


def test_runs_of_two_words_that_mirror_each_other(spark):
    mirror = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    first = [f"w{i}" for i in range(1023)]
    item = " ".join([*first, *mirror])
    docs = docs_of(spark, [" ".join([*first, *mirror.translate(str.maketrans("ab", "ba"))])])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.item_start: r.length for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got[0] == 1023


def test_longest_matches_table(spark):
    item = " ".join(WORDS)
    docs = docs_of(spark, ["x " + " ".join(WORDS[3:15]) + " y", " ".join(WORDS[3:18])])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.item_start: (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got[3] == (15, 1, 0) and got[8] == (10, 1, 5) and 9 not in got


def test_decontamination_odd_input(spark):
    bench = spark.createDataFrame([(1, "a b c"), (None, "z"), (2, "")], "item_id long, text string")
    found = decontaminate.contamination(docs_of(spark, ODD).withColumn("item_id", F.lit(9)), bench).collect()
    assert len(found) == len(ODD) and [r.n_words for r in found if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert next(r for r in found if r.doc_id == 5).n_hit == 60_000
    assert not any(r.contaminated for r in decontaminate.contamination(docs_of(spark, ODD), bench.limit(0)).collect())
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


# --- 3, 5: packing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.public_bpe()[0])
    return lambda t: [*slow.encode(t or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_tokenizers(reference_ids, text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encoder(*tokens.public_bpe())(text).tolist() == reference_ids(text)


def test_ids_of_special_strings(reference_ids):
    assert tokens.encoder(*tokens.public_bpe())("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]
    for t in ("é<|endoftext|>", "日本<|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext|>", "a<|endoftext|> b", " x y", "don't  stop\n\n ñandú ßüß", "x" * 5000, None):
        assert tokens.encoder(*tokens.public_bpe())(t).tolist() == reference_ids(t)


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_a_packing(case):
    capacity, lengths = case
    counts = collections.Counter(lengths)
    runs, bins = bestfit.plan(dict(counts), capacity)
    held = collections.defaultdict(list)
    numbers = collections.Counter()
    for n, a, b, first, each, offset in runs:
        assert a == numbers[n]
        numbers[n] = b
        for k in range(b - a):
            held[first + k // each].append((offset + k % each * n, n))
    assert numbers == counts and sorted(held) == list(range(bins))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    large = [n for n in lengths if 3 * n > capacity]
    assert bins >= -(-sum(lengths) // capacity) and bins <= max(-(-3 * sum(lengths) // (2 * capacity)) + 1, len(large) + 1)
    decreasing = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for s in decreasing for i in s) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in s) <= capacity for s in decreasing)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=60))
def test_segment_tree_is_best_fit(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    assert len(packing.best_fit_decreasing(lengths, capacity)) == len(rooms)


def packable():
    rng = random.Random(5)
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(60)] + ["a b c d e f g"] * 40 + [None, ""]


def test_best_fit_round_trip(spark, reference_ids):
    texts = packable()
    rows = bestfit.pack(docs_of(spark, texts)).collect()
    ids = [np.array(reference_ids(t), "<u4") for t in texts]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[d])
        assert all(n == 1024 for _, _, n in pieces[1:])
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    assert len(by_doc) == len(texts) and len(by_sequence) <= -(-sum(map(len, ids)) // 1024) + 1


def test_packed_ids_round_trip(spark, reference_ids, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    texts = packable()
    packed = packing.pack(docs_of(spark, texts)).collect()
    back = collections.defaultdict(list)
    for r in packed:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            back[s.doc_id].append((s.piece, ids[a:b].tolist()))
    assert len({r.sequence_id for r in packed}) == len(packed)
    for d, t in enumerate(texts):
        assert [x for _, p in sorted(back[d]) for x in p] == reference_ids(t)
    assert packing.unpack(packing.pack(docs_of(spark, texts))).count() == sum(len(v) for v in back.values())


def test_packing_odd_input(spark, reference_ids):
    odd = docs_of(spark, ODD, [1, 1, None, None, 2, 3, 4, 5, 5]).withColumns({"salt": F.lit(1), "length": F.lit("x"), "number": F.lit(0)})
    total = sum(len(reference_ids(t)) for t in ODD)
    assert bestfit.pack(odd).agg(F.sum("length")).first()[0] == total
    assert packing.pack(odd).agg(F.sum("n_tokens")).first()[0] == total
    assert bestfit.pack(docs_of(spark, [])).count() == 0 and packing.pack(docs_of(spark, [])).count() == 0


# --- 8: top-k --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "n", "dim", "scale"), [(1, 300, 8, 64), (2, 60, 3, 2), (3, 10, 4, 64), (4, 200, 5, 1 << 27)])
def test_top_k_matches_brute_force(spark, seed, n, dim, scale, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "STEP", 24)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[n // 2 :: 7] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), scale=scale).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = [[int(np.floor(scale * c)) for c in v] for v in x]
    for q in range(0, n, 20):
        scores = [(-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in range(n) if i != q]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:20]]


def test_top_k_in_passes_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 5)]) for i in range(300)] + [(7, [1.0, 0.0, 2.0, -1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = df.filter("vec_id % 3 = 0")
    whole = sorted(topk.top_k(df, asked, scale=1).collect())
    monkeypatch.setattr(topk, "PASS_BYTES", 1000)
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert sorted(topk.top_k(df, asked, scale=1).collect()) == whole and len(whole) == 2000
    by = dict(rows[:300])
    for q in (0, 150, 297):
        want = sorted((-sum(a * b for a, b in zip(by[q], v, strict=True)), i) for i, v in rows if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in whole if r.query_id == q] == want


@pytest.mark.parametrize("k", [20, 255, 256, 257, 300])
def test_top_k_of_full_blocks(spark, k, monkeypatch):
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (9000, 4)) + 9 * rng.integers(-1, 2, (9000, 1))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    blocks = topk._blocks(df.selectExpr("vec_id id", "embedding v"), 4, np.zeros((1, 5)), 1e9, "<f8")
    assert [r.n for r in blocks.selectExpr("octet_length(ids) / 8 n").collect()] == [4096, 4096, 808]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.filter("vec_id % 3000 = 0"), k=k, scale=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 9000, 3000):
        s = x @ x[q]
        order = np.lexsort((np.arange(9000), -s))
        assert got[q] == [(int(i), int(s[i])) for i in order if i != q][:k]


def test_best_bounds_are_scored_first(monkeypatch):
    """With bounds that tell candidates apart, most of a block isn't scored."""
    scored = []
    product = topk._product
    monkeypatch.setattr(topk, "_product", lambda a, b, wide: scored.append(len(a) * len(b)) or product(a, b, wide))
    rng = np.random.default_rng(2)
    x, q = rng.integers(-9, 9, (4096, 4)).astype(float), rng.integers(-9, 9, (5, 4)).astype(float)
    topk._best(q @ x.T + 1, q, x, np.full(5, -np.inf), 20, False)
    assert sum(scored) < 5 * 4096 / 4


def test_repeated_query_ids_answer_for_the_smallest_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.0, 2.0]), (9, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(df, asked, k=1, scale=1).collect()] == [2]


@pytest.mark.parametrize("wide", [False, True])
def test_bound_order_loses_nothing(wide, monkeypatch):
    monkeypatch.setattr(topk, "STEP", 24)
    rng = np.random.default_rng(6)
    for slack in (0, 3, 400):
        x, q = rng.integers(-9, 9, (300, 4)).astype(float), rng.integers(-9, 9, (15, 4)).astype(float)
        true = q @ x.T
        top = true + rng.random(true.shape) * slack
        top[3] = -np.inf
        floor = np.where(np.arange(15) % 2 == 0, -np.inf, np.sort(true, axis=1)[:, -40])
        i, j, s = topk._best(top, q, x, floor.copy(), 20, wide)
        for row in range(15):
            got = sorted(zip(-s[i == row], j[i == row], strict=True))[:20]
            want = sorted(zip(-true[row], range(300), strict=True))[:20]
            assert got == ([] if row == 3 else [(v, c) for v, c in want])


def test_top_k_odd_input(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0]), (None, [1.0, 1.0]), (6, []), (0, [1.0, 2.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "score": F.lit(1)})
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 3 * 4096), (0, 2, 7, 3 * 4096), (0, 3, 6, 0)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


# --- 1: quality ------------------------------------------------------------------------------------------------------


def noisy(seed, n=160):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choices(WORDS, k=rng.randint(8, 20))).capitalize() + "."
    bad = lambda: rng.choice([lambda: " | ".join(rng.choices(WORDS, k=12)), lambda: "!! ".join(w.upper() for w in rng.choices(WORDS, k=12)), lambda: " ".join([rng.choice(WORDS)] * 15)])()
    texts, labels = [], []
    for i in range(n):
        label = int(i % 4 != 0)
        lines = [good() if label or rng.random() < 0.3 else bad() for _ in range(rng.randint(1, 12))]
        if not label:
            lines.append(bad())
        texts.append("\n".join(lines))
        labels.append(label)
    return texts, labels


def paths(u, move):
    """Weights of all labellings of a document's lines, one by one."""
    return {path: sum(x for x, y in zip(u, path, strict=True) if y) + sum(move[p, q] for p, q in zip(path, path[1:], strict=False)) for path in itertools.product((0, 1), repeat=len(u))}


def test_marginals_are_exact():
    texts, labels = noisy(3, 40)
    texts = ["\n".join(t.split("\n")[:8]) for t in texts]
    lines = quality.lines_of([t.encode() for t in texts])
    model = quality.fit(lines, np.array(labels))
    good, pairs, log_z = quality.marginals(model, lines)
    u = quality._evidence(model, lines)
    total, moves = 0.0, np.zeros((2, 2))
    for a, b in zip(lines.at, lines.at[1:], strict=False):
        weights = paths(u[a:b], model.move)
        z = np.logaddexp.reduce(list(weights.values()))
        for t in range(int(b - a)):
            assert good[a + t] == pytest.approx(sum(np.exp(w - z) for p, w in weights.items() if p[t]), abs=1e-9)
        for p, w in weights.items():
            for x, y in zip(p, p[1:], strict=False):
                moves[x, y] += np.exp(w - z)
        total += z
    assert log_z == pytest.approx(total) and pairs == pytest.approx(moves) and max(np.diff(lines.at)) == 8


def test_scores_equal_all_labellings(spark):
    """The whole query's scores from an enumeration of every labelling of every document."""
    texts, labels = noisy(5, 60)
    texts = ["\n".join(t.split("\n")[:7]) for t in texts] + [None, "", " \n\t\n"]
    docs = docs_of(spark, texts)
    model = quality.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))
    want = []
    for t in texts:
        own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        if not own:
            want.append(0.0)
            continue
        lines = quality.lines_of([t.encode()])
        evidence = [model.bias + sum(model.weight[o + 1, f, lines.bins[i + o, f]] for o in (-1, 0, 1) if 0 <= i + o < len(own) for f in range(lines.bins.shape[1])) for i in range(len(own))]
        weights = paths(evidence, model.move)
        z = np.logaddexp.reduce(list(weights.values()))
        size = [len(x.encode()) for x in own]
        share = sum(np.exp(w - z) * sum(s for s, y in zip(size, p, strict=True) if y) for p, w in weights.items()) / sum(size)
        share = min(max(share, 0.005), 0.995)
        want.append(1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log(share / (1 - share))))))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    texts, labels = noisy(6, 40)
    docs = docs_of(spark, [*texts, "x" * 100_000, *["y z"] * 200], [*range(40), 40, *[41] * 200])
    marks = spark.createDataFrame([*enumerate(labels), (40, 1), (41, 0), (41, 0)], "doc_id long, quality int")
    bound = quality.train(docs, marks, sample_bytes=sum(map(len, texts)) + 10)
    plain = quality.train(docs.filter("doc_id <> 40").distinct(), marks.filter("doc_id <> 40"))
    assert np.array_equal(bound.weight, plain.weight) and np.array_equal(bound.curve, plain.curve)


def test_filters_of_odd_rows(spark):
    texts, labels = noisy(9, 60)
    model = quality.train(docs_of(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))
    good = texts[1]
    odd = docs_of(spark, [None, "", " \n ", good, good, good], [1, None, 2, None, 3, 3]).withColumns({"score": F.lit("x"), "predicted": F.lit(None)})
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, good), (3, good), (3, good)]
    assert quality.keep_good(odd.limit(0), model).count() == 0
    bench = spark.createDataFrame([(1, good)], "item_id long, text string")
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and sorted((r.doc_id or 0, str(r.text)) for r in clean.collect()) == [(0, ""), (1, "None"), (2, " \n ")]
    assert decontaminate.clean(odd, bench.limit(0)).count() == 6 and decontaminate.clean(odd.limit(0), bench).count() == 0


def test_held_out_quality(spark):
    texts, labels = noisy(7, 400)
    docs = docs_of(spark, texts)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    model = quality.train(docs, marks)
    rows = quality.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}


def test_training_does_not_see_held_out_labels(spark):
    texts, labels = noisy(8, 120)
    docs = docs_of(spark, texts)
    flipped = [1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in enumerate(labels)]
    fit = lambda ys: quality.train(docs, spark.createDataFrame(list(enumerate(ys)), "doc_id long, quality int"))
    a, b = fit(labels), fit(flipped)
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.curve, b.curve)


def test_quality_odd_input(spark):
    texts, labels = noisy(9, 60)
    docs = docs_of(spark, texts)
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = quality.train(docs.withColumns({"quality": F.lit(1), "_label": F.lit("x")}), marks)
    odd = docs_of(spark, ODD, [None, *range(1, len(ODD))]).withColumn("score", F.lit("x"))
    got = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert got[None] == got[1] == got[2] == 0 and len(got) == len(ODD)
    assert quality.score(docs.limit(0), model).count() == 0
    blank = quality.train(docs, marks.limit(0))
    assert all(r.score == 0.5 for r in quality.score(docs, blank).collect())
    same = quality.train(docs, marks.filter("quality = 1"))
    assert all(r.score > 0.5 for r in quality.score(docs, same).collect())


# --- 6: language -----------------------------------------------------------------------------------------------------

TONGUES = {"aa": "kalo mira tunke velo sari", "bb": "schrum pflicht achtung zwisch", "cc": "ñandu óxido raíz está"}


def spoken(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice([*TONGUES])
        rows.append((i, " ".join(rng.choices(TONGUES[lang].split(), k=rng.randint(2, 40))).capitalize() + f" {i}!", lang, "s", 0))
    return rows


def test_bundles_equal_slow_binding():
    texts = ["Ab, ça b", "", "ÇA", "漢字 \U00030001x\u0301"]
    doc, code, count, has = language.trigrams([t.encode() for t in texts])
    assert has.tolist() == [True, False, True, True]
    vector = {c: language.letter_vectors(np.array([c]), 64)[0].astype(int) for c in {0, *(ord(c) for t in texts for c in t.lower())}}
    for i, t in enumerate(texts):
        letters = [0, *[0 if c in ", " else ord(c) for c in re.sub("[, ]+", " ", t.lower())], 0] if t else []
        grams = collections.Counter(zip(letters, letters[1:], letters[2:], strict=False))
        own = doc == i
        assert {(c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF): n for c, n in zip(code[own].tolist(), count[own].tolist(), strict=True)} == dict(grams)
        slow = sum((n * np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for (x, y, z), n in grams.items()), np.zeros(64))
        assert np.array_equal(language.bundles(len(texts), doc, code, count, 64)[i], slow)


def test_letters_have_vectors_of_their_own():
    points = np.array([ord(c) for c in "abßжщاپ漢字"] + [0x30000, 0x30001, 0x323AF])
    v = language.letter_vectors(points, 1024).astype(int)
    near = np.abs(v @ v.T - 1024 * np.eye(len(points)))
    assert near.max() < 200 and set(np.unique(v)) == {-1, 1}
    assert language._letters()[1][points].all()


def test_sparse_and_dense_bundles_are_equal(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh жщ漢") for _ in range(rng.choice([0, 5, 300]))).encode() for _ in range(40)]
    doc, code, count, _ = language.trigrams(texts)
    whole = language.bundles(40, doc, code, count, 128)
    monkeypatch.setattr(language, "_CODES", 7)
    assert np.array_equal(whole, language.bundles(40, doc, code, count, 128))


SCRIPTS = {
    "ru": "это был очень хороший день когда мы пошли гулять что она сказала мне потом было ещё лучше потому что все люди",
    "uk": "це був дуже гарний день коли ми пішли гуляти що вона сказала мені потім було ще краще тому що всі люди її",
    "bg": "това беше много хубав ден когато отидохме на разходка какво каза тя след това беше още по добре защото всички хора",
    "ar": "كان هذا يوما جميلا جدا عندما ذهبنا الى المدينة وقالت لي ان كل الناس هناك يعرفون بعضهم منذ زمن طويل",
    "fa": "این روز بسیار خوبی بود وقتی که به شهر رفتیم و او به من گفت که همه مردم آنجا یکدیگر را می شناسند چون گفته",
    "ur": "یہ بہت اچھا دن تھا جب ہم شہر گئے اور اس نے مجھے بتایا کہ وہاں کے سب لوگ ایک دوسرے کو جانتے ہیں",
    "zh": "今天是非常好的一天我们去了城里她告诉我那里的人都认识因为他们住了很久",
    "ja": "今日はとても良い日でした私たちは町に行きました彼女はそこの人々はみんな知り合いだと言いました",
    "xx": "".join(chr(0x30000 + 7 * i) for i in range(40)),
}


def test_languages_of_many_scripts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(360):
        lang = [*SCRIPTS][i % len(SCRIPTS)]
        words = SCRIPTS[lang].split()
        text = " ".join(rng.choices(words, k=12)) if len(words) > 1 else "".join((lambda a: words[0][a : a + 6])(rng.randrange(len(words[0]) - 6)) for _ in range(4))
        rows.append((i, text, lang, "s", 0))
    docs = spark.createDataFrame(rows, DOC)
    found = [r for r in language.identify(docs, language.train(docs)).collect() if r.held_out]
    assert len(found) > 50 and [r.doc_id for r in found if r.lang_pred != rows[r.doc_id][2]] == []


def test_sample_is_bounded_for_each_language(spark, monkeypatch):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(f"abc abd {i}", "big") for i in range(300)] + [("xyz xyw", "rare")] * 3 + [("qqq", None)])] + [(1, "abc abd 1", "big", "s", 0)] * 500
    profiles = language.train(spark.createDataFrame(rows, DOC), sample=20)
    assert profiles.languages == ["big", "rare"]
    doc, code, count, _ = language.trigrams([b"abc abd"])
    bundle = language.bundles(1, doc, code, count, language.DIM)[0]
    assert np.allclose(profiles.prototypes[0], bundle / np.linalg.norm(bundle))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé ,Bç1漢") for _ in range(rng.choice([0, 1, 3, 90, 400]))).encode() for _ in range(30)]
    whole = language.trigrams(texts)
    monkeypatch.setattr(language, "_MOST", 50)
    for a, b in zip(whole, language.trigrams(texts), strict=True):
        assert np.array_equal(a, b)


def test_held_out_language(spark):
    rows = spoken(4)
    docs = spark.createDataFrame(rows, DOC)
    found = language.identify(docs, language.train(docs)).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 < r.score <= 1 for r in held)
    kept = language.keep_known(docs, language.train(docs), languages=["aa"])
    assert {r.lang for r in kept.collect()} == {"aa"} and kept.columns == docs.columns
    # no letters, a short text and long ones: of no known language, and of one
    odd = docs_of(spark, [None, "", "12 !", "q", "漢字" * 200, rows[0][1], rows[0][1]], [1, 1, None, 2, 3, None, None]).withColumn("lang_pred", F.lit(1))
    assert [r.text for r in language.keep_known(odd, language.train(docs)).collect()] == ["q", rows[0][1], rows[0][1]]
    assert language.keep_known(odd, language.train(docs.limit(0))).count() == language.keep_known(odd.limit(0), language.train(docs)).count() == 0


def test_language_odd_input(spark):
    docs = spark.createDataFrame(spoken(5), DOC)
    profiles = language.train(docs.withColumns({"_lang": F.lit("x"), "code": F.lit(1)}))
    odd = docs_of(spark, [*ODD, "123 !!", "漢字"], [None, *range(1, len(ODD) + 2)]).withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, profiles).collect()}
    assert got[None] == got[1] == got[2] == got[len(ODD)] == ("und", 0.0)
    assert got[len(ODD) + 1][0] in TONGUES and len(got) == len(ODD) + 2
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), profiles).count() == 0


# --- 9: HTML ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h1>Site</h1><a href="/">home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this better for all of you. <a href="#">OK</a></div>
<div class="sidebar"><h3>Popular</h3><p>Words about other things that go on for a while in here.</p></div>
<article><h2>The &amp; title</h2><p>First   paragraph of the text with <b>enough</b> words &eacute; to be an article, <a href="x">really</a>.<br>More<p>Short.
<aside>pull</aside><ul><li>item one</li></ul><form><input><p>Write a comment to us here now please</p></form></article>
<section class="comments"><p>I disagree with this because it is wrong in many different ways.</p></section>
<div class="ad">Buy now</div><!-- <p>hidden</p> --><footer>&copy; 2024 rights</footer></body></html>"""


def test_main_text():
    tree = html_text.train()
    assert html_text.main_text(PAGE, tree) == "The & title\nFirst paragraph of the text with enough words é to be an article, really. More\nShort.\nitem one"
    plain = "<body><div class='menu'><a>x</a></div><h1>A heading</h1>" + "<p>" + "some words of an article that has no marks at all, " * 4 + "</p>" + "<p>" + "and a second paragraph of it that is long enough too, " * 3 + "</p><p><a>l</a> <a>m</a></p>"
    assert html_text.main_text(plain, tree).count("\n") == 2


def test_the_tree_knows_its_table_and_uses_neighbours():
    tree, table = html_text.train(), html_text.labelled(html_text.examples())
    right = 0
    for row in table:
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if row[tree.feature[node]] < tree.cut[node] else tree.right[node]
        right += tree.answer[node] == bool(row[-1])
    assert right >= 0.99 * len(table)
    used = {html_text.COLUMNS[f] for f in tree.feature if f >= 0}
    assert used >= {"words", "link_density", "words_before", "density_before", "words_after", "density_after"}


def some(n, word="word"):
    return " ".join([word] * n)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body><p>{some(220)}</p></body></html>", [some(220)]),
        (f"<body><nav><a href=x>a</a></nav><div><p>{some(60)}</p></div>", [some(60)]),
        ("just bare  text of a page", ["just bare text of a page"]),
        (f'<nav><a>x</a></nav><article class="related-story"><h1>T</h1><p>{some(50)}</p><p>{some(3)}</p></article>', ["T", some(50), some(3)]),
        (f'<nav><a>x</a></nav><div class="share content"><p>{some(80)}</p></div><footer>f</footer>', [some(80)]),
        (f"<h1>T</h1><p>{some(30)}</p><p>{some(2)}</p>", ["T", some(30), some(2)]),
        (f'<form id=f><div class=nav><a>x</a></div><p>{some(80)}</p><p>{some(4)}</p></form>', [some(80), some(4)]),
        (f'<article><p>{some(10)}</p></article><section class="comments"><p>{some(300)}</p><article class="comment"><p>{some(9)}</p></article></section>', [some(10)]),
        (f'<div class="page has-sidebar"><div class="ad">{some(12)}</div><p>{some(90)}</p><aside>{some(40)}</aside></div>', [some(90)]),
        (f"<p>{some(40)}</p><p>&copy; 2024 all of it</p>", [some(40)]),
        (f"<article><p>{some(40)}</p><p>Copyright {some(60)}</p></article>", [some(40), "Copyright " + some(60)]),
        ("<nav><ul><li><a href=x>a</a><li><a href=y>b</a></ul></nav><form><p>Your name</p></form><footer>f g h</footer>", []),
        ("", []),
    ],
)
def test_articles_of_plain_shapes(page, want):
    assert html_text.main_text(page, html_text.train()) == "\n".join(want)


def page_of(rng):
    """A random page and the blocks of its article, known by how it is made."""
    vocabulary = ["alpha", "beta", "gamma", "délta", "fish &amp; chips", "x&lt;y", "<b>bold</b>", "<em>so</em>,"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = lambda t: " ".join(re.sub("<[^>]*>", "", t).replace("&amp;", "&").replace("&lt;", "<").split())
    links = lambda k: "".join(f'<li><a href="/{i}">{rng.choice(["Home", "About us", "News", "A b c"])}</a></li>' for i in range(k))
    body = [("h1", text(rng.randint(2, 9)))] * rng.randint(0, 1)
    for _ in range(rng.randint(2, 7)):
        body.append(("p", text(rng.randint(15, 150))))
        if rng.random() < 0.2:
            body.append((rng.choice(["blockquote", "h2", "p"]), text(rng.randint(2, 12))))
    body.append(("p", text(rng.randint(5, 60))))
    inside = "\n".join(f"<{t}>{x}</{t}>" if t != "p" or rng.random() < 0.8 else f"<p>{x}" for t, x in body)
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("<div>", "</div>"), ("", ""), ('<article class="related-story">', "</article>"), ('<div class="post share">', "</div>")])
    before = "".join(x for x in (f"<header><h1>Site</h1>{text(4)}</header>", f"<nav><ul>{links(rng.randint(2, 6))}</ul></nav>", f'<div class="ad">{text(rng.randint(1, 20))}</div>', f'<div id="cookie-notice"><p>{text(18)}</p><a>OK</a></div>') if rng.random() < 0.5)
    after = "".join(x for x in (f'<aside><h3>More</h3><p>{text(rng.randint(3, 60))}</p></aside>', f'<form><p>{text(5)}</p><input></form>', f'<ul class="menu">{links(5)}</ul>', f"<footer>&copy; 2024 {text(6)}</footer>", f"<div><p>&copy; 2024 {text(3)}</p></div>") if rng.random() < 0.5)
    if "class=" not in opening and rng.random() < 0.4:
        after = f'<section class="comments">{"".join(f"<p>{text(rng.randint(2, 120))}</p>" for _ in range(rng.randint(1, 6)))}</section>' + after
    return f"<!DOCTYPE html><html><head><title>{text(3)}</title><script>var a='<p>';</script></head><body>{before}{opening}{inside}{closing}{after}</body></html>", [clean(x) for _, x in body]


def test_main_text_of_generated_pages():
    tree, rng = html_text.train(), random.Random(4)
    made = [page_of(rng) for _ in range(600)]
    wrong = [p for p, want in made if html_text.main_text(p, tree) != "\n".join(want)]
    assert not wrong, wrong[0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/!-pa \"'=&;#brdivscript", max_size=80))
def test_any_markup_is_read(page):
    html_text.main_text(page, html_text.train())


def test_html_is_linear_and_odd_input(spark):
    tree = html_text.train()
    for page in ("<a " * 20_000, "<p class='" + "x" * 200_000, "<!--" * 20_000, "<script>" + "<" * 100_000, "&" * 100_000, "<div>" * 3000, "<div class=ad>" * 30_000 + "x" + "</p>" * 30_000):
        html_text.main_text(page, tree)
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[1:3] == [(1, 0), (2, 0)] and len(got) == 5
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 10: chats -------------------------------------------------------------------------------------------------------


def brute_chats(rows):
    by = collections.defaultdict(set)
    for conv, turn, role, t in rows:
        if conv is not None:
            by[conv].add((turn is not None, turn or 0, role is not None, role or "", t is not None, t or ""))
    lists = {c: tuple((x[2:]) for x in sorted(v)) for c, v in by.items()}
    keep = {}
    for c, l in sorted(lists.items()):
        if any(len(o) > len(l) and o[: len(l)] == l for o in lists.values()) or l in [lists[k] for k in keep]:
            continue
        keep[c] = "".join(f"<|im_start|>{role if has else 'user'}\n{t}<|im_end|>\n" for has, role, _, t in l)
    return keep


@pytest.mark.parametrize("bar", ["|", "&gt;", "&middot;", "»", "/"])
def test_menus_with_marks_between_their_links(bar):
    body = "".join(f"<p>{' '.join(f'word{i * j}' for j in range(40))}</p>" for i in range(1, 4))
    menu = f" {bar} ".join(f'<a href="/{n}">{n}</a>' for n in ("Home", "About", "News"))
    got = html_text.main_text(f"<body><div>{menu}</div><article><h1>A title</h1>{body}</article></body>", html_text.train())
    assert got.startswith("A title\nword0") and "About" not in got and got.count("\n") == 3


def test_complementary_roles_are_furniture():
    body = "".join(f"<p>{' '.join(f'word{i * j}' for j in range(40))}</p>" for i in range(1, 4))
    page = f'<body><article>{body}</article><div role="complementary"><p>Ten more things that other people have read today here</p></div></body>'
    assert "Ten more" not in html_text.main_text(page, html_text.train())



def test_chats_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(80):
        base = [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, ""])) for t in range(rng.randint(1, 4))]
        rows += [(c, *x) for x in base]
        if rng.random() < 0.4:
            rows += [(c + 1000, *x) for x in base] + [(c + 1000, 9, "user", "more")]
    rows += [(5, 0, "user", "again")] * 2 + [(None, 0, "user", "x"), (7, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "chunk": F.lit("x")})
    got = {r.conv_id: r.text for r in chat_format.format_chats(df).collect()}
    assert got == brute_chats(rows) and 7 in got
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_chat_has_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(200)] + [(2, t, "user", f"t{t}") for t in range(130)] + [(3, t, "user", f"t{t}") for t in range(129)] + [(3, 129, "user", "else")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in out] == [(1, 0, 64), (1, 1, 64), (1, 2, 64), (1, 3, 8), (3, 0, 64), (3, 1, 64), (3, 2, 2)]
    assert "".join(r.text for r in out if r.conv_id == 1).count("<|im_start|>") == 200


# --- 4: URL lists ----------------------------------------------------------------------------------------------------


def test_captures_of_any_year_meet_open_entries(spark):
    entries = spark.createDataFrame([("l1", "bad.com", "1950-01-10", "add"), ("l2", "bad.com", "2024-01-10", "add"), ("l2", "bad.com", "2150-01-10", "remove")], "list string, host string, day string, action string").withColumn("day", F.col("day").cast("date"))
    days = [("1949-12-31", ""), ("1950-01-10", "l1"), ("2024-01-10", "l1,l2"), ("2101-05-05", "l1,l2"), ("2150-01-10", "l1"), ("2999-01-01", "l1"), ("9999-12-30", "l1")]
    caps = spark.createDataFrame([(i, "http://bad.com/a", d) for i, (d, _) in enumerate(days)], "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    assert [r.lists for r in url_lists.verdicts(caps, entries).orderBy("page_id").collect()] == [x for _, x in days]


def test_url_verdicts(spark):
    day = lambda s: s
    entries = spark.createDataFrame(
        [("l1", "bad.com", "2024-01-10", "add"), ("l1", "bad.com", "2024-02-10", "remove"), ("l1", "bad.com", "2025-06-01", "add"), ("l1", "BAD.com", "2024-01-20", "add"), ("l2", "x.bad.com", "2024-01-15", "add"), ("l2", "x.bad.com", "2024-01-15", "remove"), ("l3", "b.org", "2024-03-01", "add"), (None, "b.org", "2024-03-01", "add"), ("l5", "[::1]", "2024-01-01", "add"), ("l6", "10.0.0.7.", "2024-01-01", "add"), ("l7", "0.7", "2024-01-01", "add"), ("l7", "3.4]", "2024-01-01", "add"), ("l4", "b.org", "2024-03-01", "odd")],
        "list string, host string, day string, action string",
    ).withColumn("day", F.col("day").cast("date"))
    urls = [
        (1, "http://bad.com/a", "2024-01-09", ""), (2, "http://bad.com/a", "2024-01-10", "l1"), (3, "https://u:p@X.Bad.com:8080?q", "2024-02-09", "l1"), (4, "http://bad.com", "2024-02-10", ""), (5, "http://www.bad.com#f", "2030-01-01", "l1"),
        (11, "http://a@b@bad.com./x", "2024-01-10", "l1"), (12, "http://[::1]:80/", "2024-01-10", "l5"), (13, "http://[2001:db8::1.2.3.4]", "2024-01-10", ""), (14, "http://10.0.0.7/", "2024-01-10", "l6"), (15, "http://9.10.0.0.7/", "2024-01-10", "l6,l7"), (16, "HTTP://bad.com..", "2024-01-10", "l1"),
        (6, "http://notbad.com", "2024-01-20", ""), (7, None, "2024-01-20", ""), (8, "nonsense", "2024-01-20", ""), (9, "http://b.org", None, ""), (10, "http://b.org", "2024-03-01", "l3"), (10, "http://b.org", "2024-03-01", "l3"),
    ]
    caps = spark.createDataFrame([u[:3] for u in urls], "page_id long, url string, fetched string").withColumns({"fetched": F.col("fetched").cast("date"), "names": F.lit("x"), "day": F.lit(1)})
    got = sorted((r.page_id, r.lists, r.blocked) for r in url_lists.verdicts(caps, entries).collect())
    assert got == sorted((u[0], u[3], u[3] != "") for u in urls)
    assert url_lists.verdicts(caps, entries.limit(0)).filter("blocked").count() == 0
    assert url_lists.verdicts(caps.limit(0), entries).count() == 0
