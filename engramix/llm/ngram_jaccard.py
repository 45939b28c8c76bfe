"""Near-duplicate documents: exact Jaccard links over word shingles by a grouped prefix join.

1. A count sketch over all documents, sized by their bytes within bounds, estimates how often each shingle occurs. It only orders the
   shingles (rare first), so estimates cost speed at worst, never a link.
2. Each document's prefix holds its first n - ceil(t n) + 1 shingles in that order: two documents with a
   similarity of t or more share one. Documents with the same prefix and size form one group; only groups are joined.
3. Buckets of groups that share a prefix shingle give candidates: first each group with two hubs of its buckets
   (stars, linear in the groups), then, between groups that are still unconnected, every pair that passes the
   size bound and the position bound.
4. Candidates are expanded to the groups' members (one for each distinct shingle set) and verified on whole texts.

Pairs inside a component that is already connected by verified links are not compared again, so a group of m
near copies costs about m comparisons instead of m * m / 2; the components are exact nevertheless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.components import components
from engramix.llm.kernel import chunks, mix, shingle_sets, utf8
from engramix.llm.work import drop, id_filter, passes, small_batches, stored

#: Words in a shingle; similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Cells of the count sketch (a byte each where it is broadcast), least and most: one for each KB of text within these.
CELLS = 1 << 23, 1 << 26
#: Cells in each of its rows on the way there.
BLOCK = 1 << 17
#: Prefix shingles of a task that joins buckets, on average.
ENTRIES = 1 << 21

_DOC = "doc long, n long, fp1 long, fp2 long, gid long, prefix binary"
_ENTRY = "token long, gid long, n int, pos int"
_PAIR = "kind int, a long, b long, token long, gid long, n int, pos int"


def sketch(texts: DataFrame, words: int) -> np.ndarray:
    """Level (4 log2 of the estimated count over all rows) of each cell, as bytes."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells = min(max(CELLS[0], 1 << (size >> 10).bit_length()), CELLS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n_cells, np.uint32)
        for batch in batches:
            for _, run in chunks(list(dict.fromkeys(utf8(batch.column(0))))):
                np.add.at(cells, _cell(np.concatenate([*shingle_sets(run, words), np.zeros(0, np.uint64)]), n_cells), np.uint32(1))
        blocks = cells.reshape(-1, BLOCK)
        for b in np.flatnonzero(blocks.any(1)):
            low = np.minimum(blocks[b], 0xFFFF).astype(np.uint16)  # more than that in one task are as frequent as any
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(low, 1)], pa.binary())], ["block", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(c), np.uint16)
                sums[b] = sums[b] + part if b in sums else part.astype(np.int64)
        for b, s in sums.items():
            level = np.minimum(255, 4 * np.log2(np.maximum(s, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "cells"])

    parts = texts.mapInArrow(count, "block int, cells binary")
    out = np.zeros(n_cells, np.uint8)
    # summed by as many tasks as there are blocks; then some MB at a time reach the driver, the next ones on their way meanwhile
    sums = parts.repartition(n_cells // BLOCK, "block").mapInArrow(total, "block int, cells binary")
    for b, c in sums.repartition(8).toLocalIterator(prefetchPartitions=True):
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(c, np.uint8)
    return out


def _cell(shingles: np.ndarray, n_cells: int) -> np.ndarray:
    return (shingles & np.uint64(n_cells - 1)).astype(np.int64)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int, int]:
    """(size, two hashes) of a set."""
    with np.errstate(over="ignore"):
        return len(shingles), int(mix(shingles).sum()), int(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-n * percent // 100)) + 1 if n else 0


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each row (doc long, text string): its set's size and fingerprint, its group, and once a batch the prefix (in a row with an id)."""
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), words))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            ids, texts, seen = batch.column(0), utf8(batch.column(1)), set()
            known = ids.is_valid().to_pylist()
            for first, run in chunks(texts):
                rows = []
                for k, s in enumerate(shingle_sets(run, words), first):
                    n = len(s)
                    _, fp1, fp2 = _fingerprint(s)
                    p = prefix_length(n, percent)
                    key = np.sort(level[_cell(s, len(level))].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8))[:p]
                    gid = int(mix(np.append(mix(key + np.arange(p, dtype=np.uint64)).sum(dtype=np.uint64), np.uint64(n)))[:2].sum()) if n else 0
                    # rows without an id take no part, so they don't stand for those that have one
                    shown = known[k] and n and (fp1, fp2) not in seen
                    if shown:
                        seen.add((fp1, fp2))
                    rows.append((n, fp1, fp2, gid, key.tobytes() if shown else None))
                n, fp1, fp2, gid, prefix = zip(*rows, strict=True)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array(n, pa.int64()), signed(fp1), signed(fp2), signed(gid), pa.array(prefix, pa.binary())], ["doc", "n", "fp1", "fp2", "gid", "prefix"])

    return docs.select("doc", "text").mapInArrow(read, _DOC)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each prefix."""
    for batch in batches:
        gid, n = (batch.column(k).to_numpy() for k in (0, 1))
        keys = batch.column(2).to_pylist()
        for lo in range(0, len(keys), 500):
            part = [np.frombuffer(k, np.int64) for k in keys[lo : lo + 500]]
            sizes = np.array([len(k) for k in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(part)),
                    pa.array(np.repeat(gid[lo : lo + 500], sizes)),
                    pa.array(np.repeat(n[lo : lo + 500], sizes).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                ],
                ["token", "gid", "n", "pos"],
            )


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    whole = pa.Table.from_batches(batches)
    return [c.to_numpy() for c in whole.columns]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    keep = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) & (lo != hi) if len(lo) else np.zeros(0, bool)
    return lo[keep], hi[keep]


def _paired(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    a, b = _unique_pairs(*np.concatenate(held, axis=1))
    return _batches(np.zeros(len(a), np.int32), a, b, None)


def _fits(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles can be similar enough if the first that they share is at pos and at. A pair that
    is similar enough passes in the bucket of that shingle, so refusing it in others loses nothing."""
    need = -(-(n + m) * percent // (100 + percent))
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - pos, m - at) >= need)


def _stars(percent: int):
    """Over one hash partition of entries: each bucket's groups with two hubs, the smallest group id (kind 0) and the
    group with the fewest rarer shingles (kind 2), and the entries of buckets with several groups (kind 1)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        token, gid, n, pos = _columns(batches)
        order = np.lexsort((gid, pos, token))
        token, gid, n, pos = token[order], gid[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.concatenate([[True], token[1:] != token[:-1]])
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        keep = (np.maximum.reduceat(gid, at) != np.minimum.reduceat(gid, at))[which]
        by_id = np.lexsort((gid, token))[at]  # buckets have the same order and sizes
        for kind, hub in ((0, by_id[which]), (2, at[which])):
            i = np.flatnonzero(keep & (gid != gid[hub]) & _fits(n, pos, n[hub], pos[hub], percent))
            yield from _batches(np.full(len(i), kind, np.int32), gid[hub[i]], gid[i], None)
        yield from _batches(np.ones(int(keep.sum()), np.int32), None, None, [token[keep], gid[keep], n[keep].astype(np.int32), pos[keep].astype(np.int32)])

    return read


def _batches(kind: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, entry: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Batches of _PAIR's columns; those not given are null."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    given = [a, b, *(entry or [None] * 4)]
    for lo in range(0, len(kind), 50_000):
        part = slice(lo, lo + 50_000)
        m = len(kind[part])
        yield pa.RecordBatch.from_arrays([pa.array(kind[part]), *(pa.nulls(m, t) if c is None else pa.array(c[part]) for c, t in zip(given, kinds, strict=True))], ["kind", "a", "b", "token", "gid", "n", "pos"])


def _crossings(percent: int):
    """Over one hash partition of entries with components: pairs of a bucket between different components that
    pass the size bound and the position bound. Each group meets only those of fitting size, in slices."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        token, gid, n, pos, root = _columns(batches)
        order = np.lexsort((gid, n, token))
        token, gid, n, pos, root = token[order], gid[order], n[order].astype(np.int64), pos[order].astype(np.int64), root[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(at[1:], len(token))
        several = np.maximum.reduceat(root, at) != np.minimum.reduceat(root, at)
        # buckets of two, the most frequent by far, all at once
        two = at[several & (ends - at == 2)]
        two = two[_fits(n[two], pos[two], n[two + 1], pos[two + 1], percent)]
        held: list[np.ndarray] = [np.stack([gid[two], gid[two + 1]])]
        count = len(two)
        several &= ends - at > 2
        for lo, hi in zip(at[several], ends[several], strict=True):
            sizes, own = n[lo:hi], root[lo:hi]
            labels, counts = np.unique(own, return_counts=True)
            most = labels[counts.argmax()]
            # the pairs within the largest component need no look, however large it is
            few = np.flatnonzero(own != most)
            first = np.searchsorted(sizes, -(-sizes[few] * percent // 100))
            last = np.searchsorted(sizes, sizes[few] * 100 // percent, side="right")
            for i, a, b in zip(few + lo, first + lo, last + lo, strict=True):
                j = np.arange(a, b)
                j = j[(root[j] != root[i]) & ((root[j] == most) | (j > i))]
                j = j[_fits(n[i], pos[i], n[j], pos[j], percent)]
                if len(j):
                    held.append(np.stack([np.full(len(j), gid[i]), gid[j]]))
                    count += len(j)
                if count > 200_000:
                    yield from _paired(held)
                    held, count = [], 0
        yield from _paired(held or [np.zeros((2, 0), np.int64)])

    return read


def _verify(words: int, percent: int):
    """Rows (a, b, text_a, text_b) whose shingle sets are similar enough."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = list(dict.fromkeys(utf8(part.column(2)) + utf8(part.column(3))))
                sets: dict[bytes, np.ndarray] = {}
                for _, run in chunks(texts):
                    sets.update(zip(run, shingle_sets(run, words), strict=True))
                keep = []
                for x, y in zip(utf8(part.column(2)), utf8(part.column(3)), strict=True):
                    s, t = sets[x or b""], sets[y or b""]
                    both = np.sort(np.concatenate([s, t]))
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(same > 0 and 100 * same >= percent * (len(both) - same))
                yield part.select([0, 1]).filter(pa.array(keep))

    return read


def _expand(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of the group pairs (a, b), of fitting sizes."""
    left = reps.select(F.col("gid").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    right = reps.select(F.col("gid").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("ra") != F.col("rb"))
    return pairs.join(left, "a").join(right, "b").filter(fits).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def _linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the document pairs (a, b) that are similar enough. Only texts that take part are shuffled."""
    members = stored(pairs.distinct(), "candidates")
    needed = id_filter(members.select(F.explode(F.array("a", "b")).alias("doc")))
    texts = docs.filter(passes(docs.sparkSession, needed, F.col("doc"))).select("doc", "text")
    with_a = members.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    out = stored(both.mapInArrow(_verify(words, percent), "a long, b long"), "links")
    drop(members)
    return out


class _Classes(NamedTuple):
    signed: DataFrame  # doc, n, fp1, fp2, gid, prefix of every row
    sets: DataFrame  # fp1, fp2, n, component_id: the smallest id over the set's links
    links: DataFrame  # a, b: verified links between sets' smallest ids


def _classes(rows: DataFrame, words: int, percent: int) -> _Classes:
    """The distinct sets of the rows (doc long, text string) with their components."""
    spark = rows.sparkSession
    small_batches(spark)
    signed = stored(prefixes(rows, words, percent), "signatures")
    sets = signed.filter("n > 0 and doc is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.min("gid").alias("gid"))
    reps = stored(sets, "sets")
    shown = signed.filter("prefix is not null and doc is not null").select("gid", "n", "prefix")
    n_entries = (shown.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // ENTRIES))
    entries = shown.mapInArrow(_explode, _ENTRY)
    stars = stored(entries.repartition(parts, "token").mapInArrow(_stars(percent), _PAIR), "stars")
    # each group with the hub of either kind that it shares most buckets with: two comparisons for each group
    shares = stars.filter("kind <> 1").groupBy("kind", "a", "b").agg(F.count("*").alias("c"))
    best = shares.groupBy("kind", "b").agg(F.max_by("a", F.struct(F.col("c"), F.xxhash64("a"))).alias("a"))
    star = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    # a group of several sets: its members against the smallest one first
    hubs = reps.groupBy("gid").agg(F.min("rep").alias("a"))
    inner = reps.join(hubs, "gid").filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = _linked(_expand(star, reps, percent).unionByName(inner), rows, words, percent)
    roots = components(links)
    labelled = reps.join(roots, F.col("rep") == F.col("node"), "left").select("gid", "rep", F.coalesce("root", "rep").alias("root"))
    # a group whose members are in several components is a unit of its own in the second step
    ends = labelled.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    unit = ends.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-F.abs("gid") - 1).alias("root"))
    shared = stars.filter("kind = 1").select("token", "gid", "n", "pos").join(unit, "gid")
    cross = shared.select("token", "gid", "n", "pos", "root").repartition(parts, "token").mapInArrow(_crossings(percent), _PAIR)
    second = cross.select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    split = labelled.join(ends.filter("low <> high").select("gid"), "gid")
    others = split.select("gid", F.col("rep").alias("b"), F.col("root").alias("other"))
    inner = split.join(others, "gid").filter("rep < b and root <> other").select(F.col("rep").alias("a"), "b")
    more = _linked(_expand(second, reps, percent).unionByName(inner), rows, words, percent)
    drop(stars, star)
    every = links.unionByName(more)
    by_set = reps.join(components(every), F.col("rep") == F.col("node"), "left").select("fp1", "fp2", "n", F.col("rep"), F.coalesce("root", "rep").alias("component_id"))
    return _Classes(signed, by_set, every)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id long, n_shingles long, component_id long) for each row of docs.

    component_id is the smallest id reachable over links, the row's own id included; two documents link if
    100 * |A & B| >= percent * |A | B| for their sets of distinct shingles (words separated by ASCII white space,
    A-Z lower-cased; fewer words than a shingle: the whole sequence as one).
    Null or empty texts and texts without words have empty sets, which link with nothing. Rows with a null id
    are returned with a null component. Rows that repeat an id count as one node with the links of each of their texts.
    An empty table gives no rows. Other columns are ignored."""
    signed, sets, links = _classes(_rows(docs, id_col, text_col), words, percent)
    # an id that several sets share is one node: its sets' components are one
    shared_ids = signed.filter("n > 0 and doc is not null").groupBy("doc").agg(F.count_distinct("fp1", "fp2", "n").alias("k")).filter("k > 1")
    if shared_ids.limit(1).count():
        own = signed.filter("n > 0 and doc is not null").join(sets, ["fp1", "fp2", "n"])
        tied = own.join(shared_ids, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("component_id").alias("b"))
        whole = components(links.unionByName(tied).unionByName(own.select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
        by_doc = signed.select("doc", F.col("n").alias("n_shingles")).join(whole, F.col("doc") == F.col("node"), "left")
        return by_doc.select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("root", "doc").alias("component_id"))
    out = signed.select("doc", "fp1", "fp2", "n").join(sets, ["fp1", "fp2", "n"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def _signed(rows: DataFrame, words: int) -> DataFrame:
    """rows (doc, text, row) as (doc, n, fp1, fp2, row): the size and the fingerprints of each text's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(1))):
                part = batch.slice(first, len(run))
                n, fp1, fp2 = zip(*(_fingerprint(s) for s in shingle_sets(run, words)), strict=True)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), signed(fp1), signed(fp2), part.column(2)], ["doc", "n", "fp1", "fp2", "row"])

    return rows.mapInArrow(sign, T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "n", "fp1", "fp2")] + [rows.schema["row"]]))


def _sets_of_texts(rows: DataFrame, several: DataFrame, words: int, percent: int) -> DataFrame:
    """(fp1, fp2, n, component_id, least) of the sets where each text of the ids in several (doc) is a document of its own; least
    is the smallest id among the component's rows."""
    spark = rows.sparkSession
    several = stored(several, "several")
    may = F.coalesce(passes(spark, id_filter(several), F.col("doc")), F.lit(False))
    split = _signed(rows.filter(may).select("doc", "text", F.col("text").alias("row")), words).join(several.withColumn("again", F.lit(True)), "doc", "left")
    own = F.when(F.col("again") & (F.col("n") > 0), F.xxhash64("doc", "fp1", "fp2", "n")).otherwise(F.col("doc"))
    split = stored(split.select(own.alias("doc"), F.col("doc").alias("of"), F.col("row").alias("text")), "split")
    signed, sets, _ = _classes(rows.filter(~may).unionByName(split.select("doc", "text")), words, percent)
    met = signed.filter("doc is not null").select("doc", "fp1", "fp2", "n").join(sets, ["fp1", "fp2", "n"]).join(split.select("doc", "of").distinct(), "doc", "left")
    least = met.groupBy("component_id").agg(F.min(F.coalesce("of", "doc")).alias("least"))
    return stored(sets.join(least, "component_id").select("fp1", "fp2", "n", "component_id", "least"), "sets")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each group of near duplicates: that with the smallest id.

    Groups are of texts: rows that repeat an id with texts that don't link belong to a group each. Of the rows that have
    their group's smallest id one stays, the first by its columns (so too for rows of an id without words: null, empty or
    blank). Other documents without words and all rows with a null id stay. An empty table stays empty. Only rows that may go (by a bounded filter of ids)
    take part in joins."""
    rows = _rows(docs, id_col, text_col)
    signed, sets, _ = _classes(rows, words, percent)
    sets = sets.withColumn("least", F.col("component_id"))
    several = signed.filter("n > 0 and doc is not null").groupBy("doc").agg(F.count_distinct("fp1", "fp2", "n").alias("k")).filter("k > 1").select("doc")
    if several.limit(1).count():
        sets = _sets_of_texts(rows, several, words, percent)
    marked = signed.filter("doc is not null").join(sets, ["fp1", "fp2", "n"], "left").groupBy("doc").agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(F.col("least") < F.col("doc"), F.lit(False))).alias("all"))
    # an id whose rows all go needs no second look; the rows of one that has several are judged one by one
    judged = stored(marked.select(F.col("doc").alias("engramix doc"), (F.col("rows") > 1).alias("engramix again"), F.col("all").alias("engramix gone")).filter("`engramix again` or `engramix gone`"), "gone")
    own = F.col(id_col).cast("long")
    may = F.coalesce(passes(docs.sparkSession, id_filter(judged.select("engramix doc")), own), F.lit(False))
    asked = docs.filter(may)
    kept = asked.join(judged, own == F.col("`engramix doc`"), "left_anti")
    out = docs.filter(~may).unionByName(kept)
    if not judged.filter("`engramix again` and not `engramix gone`").limit(1).count():
        return out
    again = asked.join(judged.filter("`engramix again` and not `engramix gone`"), own == F.col("`engramix doc`"), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    placed = _signed(again.select(own.alias("doc"), F.col(text_col).cast("string").alias("text"), whole), words)
    order = F.struct(*(F.col("row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    own_group = placed.join(sets.select("fp1", "fp2", "n", "component_id", "least"), ["fp1", "fp2", "n"], "left").filter("component_id is null or least = doc")
    first = own_group.groupBy("doc", "component_id").agg(F.min_by("row", order).alias("row"))
    return out.unionByName(first.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def _counted(words: int, percent: int):
    """Rows (a, b, text_a, text_b) whose shingle sets are similar enough, as (a, b, shared, total)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = list(dict.fromkeys(t or b"" for c in (2, 3) for t in utf8(part.column(c))))
                sets: dict[bytes, np.ndarray] = {}
                for _, run in chunks(texts):
                    sets.update(zip(run, shingle_sets(run, words), strict=True))
                rows = []
                for a, b, x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), utf8(part.column(3)), strict=True):
                    s, t = sets[x or b""], sets[y or b""]
                    both = np.sort(np.concatenate([s, t]))
                    same = int((both[1:] == both[:-1]).sum())
                    if same and 100 * same >= percent * (len(both) - same):
                        rows.append((a, b, same, len(both) - same))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "shared", "total"])

    return read


def _joined(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): the whole join between distinct sets, each known by its smallest id, and the class of each row."""
    spark = rows.sparkSession
    small_batches(spark)
    signed = stored(prefixes(rows, words, percent), "signatures")
    own = signed.filter("n > 0 and doc is not null")
    reps = stored(own.groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.min("gid").alias("gid")), "sets")
    shown = signed.filter("prefix is not null and doc is not null").select("gid", "n", "prefix")
    n_entries = (shown.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // ENTRIES))
    # equal prefixes of one group count once; every group is a unit of its own, so all pairs of a bucket are looked at
    entries = shown.mapInArrow(_explode, _ENTRY).groupBy("token", "gid").agg(F.min("n").alias("n"), F.min("pos").alias("pos")).withColumn("root", F.col("gid"))
    met = entries.select("token", "gid", "n", "pos", "root").repartition(parts, "token").mapInArrow(_crossings(percent), _PAIR).select("a", "b").distinct()
    inner = reps.select("gid", F.col("rep").alias("a")).join(reps.select("gid", F.col("rep").alias("b")), "gid").filter("a < b").select("a", "b")
    members = stored(_expand(met, reps, percent).unionByName(inner).distinct(), "candidates")
    needed = id_filter(members.select(F.explode(F.array("a", "b")).alias("doc")))
    texts = rows.filter(passes(spark, needed, F.col("doc"))).groupBy("doc", "text").agg(F.count("*").alias("c"))
    both = members.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(_counted(words, percent), "a long, b long, shared long, total long")
    best = found.groupBy("a", "b").agg(F.max_by(F.struct("shared", "total"), F.col("shared") / F.col("total")).alias("s"))
    pairs = stored(best.select("a", "b", "s.shared", "s.total"), "pairs")
    drop(members)
    classes = signed.select("doc", "fp1", "fp2", "n").join(reps, ["fp1", "fp2", "n"], "left").select("doc", "n", "rep")
    return pairs, classes


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The join itself: (a, b, shared, total), a < b, for every two distinct shingle sets that link, each known by the smallest id
    that has it, with the sizes of their intersection and union.

    Copies aren't expanded: linked() tells the class of each row. Rows without words or id take no part; an id with several
    texts stands for each of their sets; an empty table gives no rows. Every candidate pair is verified on whole texts, so
    the work grows with the pairs that link; near_duplicates() finds the components with less."""
    return _joined(_rows(docs, id_col, text_col), words, percent)[0]


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) for each row: the smallest id with its shingle set, and how many other rows it links
    with (copies and similar sets). Rows without words have their own id as class and no links; null ids have a null class."""
    pairs, classes = _joined(_rows(docs, id_col, text_col), words, percent)
    sizes = classes.filter("rep is not null and doc is not null").groupBy("rep").agg(F.count("*").alias("rows"))
    either = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    links = either.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("rows").alias("linked"))
    counted = sizes.join(links, "rep", "left").select("rep", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = classes.join(counted, "rep", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("class_id"), F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))


#: DuckDB SQL for near_duplicates(documents) on small tables: all pairs that share a shingle, then their transitive closure.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM split),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
near AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT near.doc_id, e.b FROM near JOIN both_ways e ON e.a = near.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM near WHERE near.doc_id = sets.doc_id), doc_id)) AS component_id FROM sets
"""
