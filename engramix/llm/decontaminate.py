"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards of bounded size, builds a word-level suffix array of each shard (sorted
as deep as the longest benchmark item), and finds every benchmark suffix in it by binary search. The neighbours of
the place found give the longest verbatim match and its location; the range of a window gives all its occurrences.
Documents never leave their task: nothing is shuffled, and shards grow in number, not in size, with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.kernel import ALNUM, hash_words, mix, utf8
from engramix.llm.work import small_batches, stored

#: Consecutive item words that count as leaked.
WINDOW = 10
#: Bytes of text in a shard (one longer document makes a shard alone).
SHARD_BYTES = 3 << 20
#: Bytes of benchmark text broadcast at once; a larger benchmark is taken in several passes.
BENCH_BYTES = 16 << 20

_FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_SPANS = "row long, doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


class Items(NamedTuple):
    """Benchmark suffixes: word hashes of all items, item of each word, words left from each, names of the items."""

    words: np.ndarray
    item: np.ndarray
    left: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]]) -> Items:
        words, at = hash_words([(t or "").encode() for _, t in rows], ALNUM)
        sizes = np.diff(at)
        left = np.repeat(at[1:], sizes) - np.arange(len(words))
        return cls(words, np.repeat(np.arange(len(rows)), sizes), left, [n for n, _ in rows])

    def depth(self) -> int:
        return int(self.left.max(initial=0))


#: Primes below 2^31 with a base each: a run's hash is a pair of polynomials modulo them.
_PRIMES = ((2147483647, 1284865837), (2147483629, 1812433253))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the prime, twice as many each time."""
    out = np.ones(n, np.int64)
    k = 1
    while k < n:
        m = min(k, n - k)
        np.multiply(out[:m], pow(base, k, prime), out=out[k : k + m])
        out[k : k + m] %= prime
        k *= 2
    return out


class Sums(NamedTuple):
    """Hashes of any run of a sequence from prefix sums: equal runs have equal hashes wherever they are. Powers of two as
    moduli would give some runs of two words equal hashes whatever the base, so they are primes."""

    sums: list[np.ndarray]
    back: list[np.ndarray]

    @classmethod
    def of(cls, values: np.ndarray) -> Sums:
        mixed = mix(values.astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
        sums, back = [], []
        for prime, base in _PRIMES:
            terms = (mixed % np.uint64(prime)).astype(np.int64) * _powers(base, prime, len(values)) % prime
            sums.append(np.concatenate([[0], np.cumsum(terms) % prime]))  # 2^32 words before a sum is beyond 64 bits
            back.append(_powers(pow(base, -1, prime), prime, len(values) + 1))
        return cls(sums, back)

    def run(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((s[end] - s[first]) % prime * b[first] % prime for s, b, (prime, _) in zip(self.sums, self.back, _PRIMES, strict=True))
        return one << 31 | two


class Shard:
    """The suffix array of the documents' words, sorted by the first `depth` words of each suffix."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        words, at = hash_words(texts, ALNUM)
        self.n_words = np.diff(at)
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        n = len(words) + len(texts)
        self.place = np.arange(len(words)) + doc  # one separator (0) ends each document
        self.seq = np.zeros(n + 64, np.int32)
        self.seq[self.place] = rank + 1
        self.doc_begin = at[:-1] + np.arange(len(texts))
        self.doc = np.full(n, -1, np.int32)
        self.doc[self.place] = doc
        self._sort(n, min(depth, n))
        self.sums: Sums | None = None  # made for the first search

    def _sort(self, n: int, depth: int) -> None:
        bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        k = max(1, min(63 // bits, 8))
        key = np.zeros(n, np.int64)
        for j in range(k):
            key = key << bits | self.seq[j : n + j]
        sa = self.place[np.argsort(key[self.place], kind="stable")]
        sorted_key = key[sa]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(sa) else np.zeros(0, bool)
        group = np.maximum.accumulate(np.where(fresh, np.arange(len(sa)), 0)) if len(sa) else np.zeros(0, np.int64)
        rank = np.full(n + 2 * max(depth, 8) + 64, -1, np.int64)
        rank[sa] = group
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True))) if len(sa) else np.zeros(0, np.int64)
        while k < depth and len(tied):  # prefix doubling, on the suffixes that are still equal only
            own = sa[tied]
            first, second = rank[own], rank[np.minimum(own + k, len(rank) - 1)]
            order = np.lexsort((second, first))
            own, first, second = own[order], first[order], second[order]
            sa[tied] = own
            fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0))
            tied = tied[~(fresh & np.append(fresh[1:], True))]
            k *= 2
        self.sa = sa

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Benchmark words as ranks here; words that don't occur get one beyond all."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == words if len(self.vocabulary) else np.zeros(len(words), bool)
        return np.where(known, at + 1, len(self.vocabulary) + 1).astype(np.int32)


class Search:
    """Suffixes of benchmark items (position in their words) in a shard. Comparisons find the first different word by
    halving over hashes of runs, so their cost doesn't grow with the items' lengths."""

    def __init__(self, shard: Shard, items: Items) -> None:
        if shard.sums is None:
            shard.sums = Sums.of(shard.seq)
        self.shard, self.left = shard, items.left
        self.ranks = np.append(shard.ranks(items.words), np.int32(0))
        self.sums = Sums.of(self.ranks)
        unknown = np.append(np.flatnonzero(self.ranks[:-1] > len(shard.vocabulary)), len(items.words))
        every = np.arange(len(items.words))
        #: Words from each position up to one that the shard doesn't have: no match is longer.
        self.run = np.minimum(unknown[np.searchsorted(unknown, every)] - every, items.left)

    def common(self, at: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words of the items from `at` and the documents from `place`, up to `most`."""
        most = np.minimum(most, len(self.shard.seq) - place)
        low, width = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
        high = most.copy()
        going = np.flatnonzero(most > 0)
        while len(going):  # twice as far each time
            end = np.minimum(low[going] + width[going], most[going])
            same = self._same(at[going], place[going], low[going], end)
            high[going[~same]] = end[~same] - 1
            low[going[same]] = end[same]
            going = going[same & (end < most[going])]
            width[going] *= 2
        while len(going := np.flatnonzero(low < high)):
            mid = (low[going] + high[going] + 1) // 2
            same = self._same(at[going], place[going], low[going], mid)
            low[going[same]] = mid[same]
            high[going[~same]] = mid[~same] - 1
        return low

    def _same(self, at: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.sums.run(at + first, at + end) == self.shard.sums.run(place + first, place + end)

    def bound(self, at: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
        """The first place of the suffix array whose suffix isn't below the items' `most` words from `at`; upper: the first
        whose suffix doesn't begin with them or with something below them."""
        sa = self.shard.sa
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
        while len(going := np.flatnonzero(lo < hi)):
            mid = (lo[going] + hi[going]) // 2
            same = self.common(at[going], sa[mid], most[going])
            whole = same == most[going]
            step = np.where(whole, 0, same)
            below = np.where(whole, upper, self.shard.seq[sa[mid] + step] < self.ranks[at[going] + step])
            lo[going] = np.where(below, mid + 1, lo[going])
            hi[going] = np.where(below, hi[going], mid)
        return lo

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest verbatim match of the items' suffixes from `at`."""
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        sa = self.shard.sa
        if not len(sa):
            return best, where
        found = self.bound(at, self.left[at], False)
        for near in (np.maximum(found - 1, 0), np.minimum(found, len(sa) - 1)):
            length = self.common(at, sa[near], self.left[at])
            where = np.where(length > best, sa[near], where)
            best = np.maximum(best, length)
        return best, where

    def blocks(self, need: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of the suffixes that may match `need` words, in blocks of bounded size."""
        some = np.flatnonzero((self.run >= need) & (need > 0))
        for lo in range(0, len(some), 1 << 17):
            yield some[lo : lo + (1 << 17)]


def _hits(shard: Shard, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit flag of each place, and the pairs doc, item that share a window)."""
    marks = np.zeros(len(shard.doc) + 1, np.int64)
    docs, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    search = Search(shard, items)
    whole = np.bincount(items.item, minlength=len(items.names))[items.item] if len(items.words) else np.zeros(0, np.int64)
    need = np.minimum(window, whole)
    for at in search.blocks(need):
        length, _ = search.longest(at)
        at = at[length >= need[at]]
        lo, hi = search.bound(at, need[at], False), search.bound(at, need[at], True)
        for i in np.flatnonzero(hi > lo):
            places = shard.sa[lo[i] : hi[i]]
            np.add.at(marks, places, 1)
            np.add.at(marks, places + need[at[i]], -1)
            held = np.unique(shard.doc[places])
            docs.append(held)
            which.append(np.full(len(held), items.item[at[i]]))
    return np.cumsum(marks)[:-1] > 0, np.concatenate(docs), np.concatenate(which)


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Runs of whole rows with about SHARD_BYTES of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        own, lo = utf8(batch.column(text)), 0
        for i, t in enumerate(own):
            t = t or b""
            if texts and size + len(t) > SHARD_BYTES:
                yield [*held, batch.slice(lo, i - lo)], texts
                held, texts, size, lo = [], [], 0, i
            texts.append(t)
            size += len(t) + 1
        held.append(batch.slice(lo))
    if texts:
        yield held, texts


def _per_doc(shard: Shard, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[str]]]:
    hit, docs, which = _hits(shard, items, window)
    n_hit = np.bincount(shard.doc[hit & (shard.doc >= 0)], minlength=len(shard.n_words))
    names: dict[int, set[str]] = {}
    for d, w in zip(docs.tolist(), which.tolist(), strict=True):
        names.setdefault(d, set()).add(items.names[w])
    return hit, n_hit, {d: sorted(s) for d, s in names.items()}


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark's rows with an id, in frames of about BENCH_BYTES at most."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BENCH_BYTES) or 1
    return [rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _load(block: DataFrame):
    rows = sorted((r.item, r.text) for r in block.collect())
    return block.sparkSession.sparkContext.broadcast(Items.of(rows))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A window is `window`
    consecutive words of an item, or a shorter item's words as a whole. Null or empty texts have no words and no
    hits; items without an id or without words take no part; an item given in several rows counts once, with
    the windows of each. Repeated and null doc ids are kept row by row; an empty benchmark hits nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col)
    if len(blocks) > 1:
        return _in_passes(rows, blocks, window)
    shared = _load(blocks[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        none = _digest([])
        for held, texts in _shards(batches, 1):
            shard = Shard(texts, items.depth())
            _, n_hit, names = _per_doc(shard, items, window)
            ids = pa.concat_arrays([b.column(0) for b in held])
            digests = [_digest(names[i]) if i in names else none for i in range(len(texts))]
            counts = [len(names.get(i, ())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard.n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(counts, pa.int64()), pa.array(digests), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(scan, _FOUND)


def _in_passes(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """contamination() for a benchmark that is too large to broadcast: a pass for each block, merged by row."""
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = None
    for block in blocks:
        shared = _load(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for held, texts in _shards(batches, 2):
                shard = Shard(texts, items.depth())
                hit, _, names = _per_doc(shard, items, window)
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                doc = shard.doc[a]
                spans: list[list[dict]] = [[] for _ in texts]
                for d, x, y in zip(doc.tolist(), (a - shard.doc_begin[doc]).tolist(), (b - shard.doc_begin[doc]).tolist(), strict=True):
                    spans[d].append({"a": x, "b": y})
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(0) for h in held]), pa.concat_arrays([h.column(1) for h in held]), pa.array(shard.n_words.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([names.get(i, []) for i in range(len(texts))], pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])

        part = stored(rows.mapInArrow(scan, _SPANS), "spans")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("long").alias("n")), lambda s: s["n"])
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every benchmark suffix over all documents, if it has at least `least` words:
    (item_id string, item_start long, length long, doc_id long, doc_start long). Ties go to the smallest doc_id, then
    the first place found. Documents without an id take no part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = _load(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            begins = np.searchsorted(items.item, np.arange(len(items.names)))
            for held, texts in _shards(batches, 1):
                shard = Shard(texts, items.depth())
                ids = pa.concat_arrays([b.column(0) for b in held]).to_numpy()
                search = Search(shard, items)
                for at in search.blocks(np.full(len(items.words), least)):
                    length, place = search.longest(at)
                    keep = length >= least
                    at, length, place = at[keep], length[keep], place[keep]
                    doc = shard.doc[place]
                    item = items.item[at]
                    yield pa.RecordBatch.from_arrays([pa.array([items.names[i] for i in item], pa.string()), pa.array(at - begins[item]), pa.array(length), pa.array(ids[doc]), pa.array(place - shard.doc_begin[doc])], ["item_id", "item_start", "length", "doc_id", "doc_start"])

        part = rows.mapInArrow(scan, "item_id string, item_start long, length long, doc_id long, doc_start long")
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("length", "doc_id", "doc_start"), F.struct(F.col("length"), -F.col("doc_id"), -F.col("doc_start"))).alias("m")
    return out.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", "m.length", "m.doc_id", "m.doc_start")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs, all columns, without the rows that hold a window of a benchmark item. Rows without words (null or empty texts too)
    stay. Repeated rows and null ids are judged row by row, other columns aren't looked at; an empty table stays empty, and
    an empty benchmark removes nothing."""
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = _load(block)
        column = out.columns.index(text_col)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for held, texts in _shards(batches, column):
                _, n_hit, _ = _per_doc(Shard(texts, items.depth()), items, window)
                at = 0
                for batch in held:
                    yield batch.filter(pa.array(n_hit[at : at + len(batch)] == 0))
                    at += len(batch)

        out = out.mapInArrow(scan, T.StructType(out.schema.fields))
    return out


_ORACLE_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: DuckDB SQL for contamination(documents, benchmark) on small tables: every window is joined by its text.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_ORACLE_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ORACLE_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
leaks AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
windows AS (
  SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM leaks) WHERE len(w) >= k)),
met AS (SELECT row, windows.k, i, item FROM windows JOIN leaks USING (k, g)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM met) GROUP BY row),
named AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
