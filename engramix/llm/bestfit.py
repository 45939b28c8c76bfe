"""Packing of token sequences with large-item matching, planned on the histogram of lengths.

Lengths are at most the capacity, so the driver needs a table of at most `capacity` counts, whatever the size of the
corpus. On it, pieces above one third of the capacity, of which a bin holds two at most, are paired greedily (the
largest with the largest that fits); smaller ones then best-fit the gaps, largest first. The plan is a list of runs:
"pieces number i to j of length l go to bins from b on, t in each, from offset o". Pieces are numbered in two steps
(within salted groups, then the groups), so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.llm.tokens import cut, encoder, public_bpe
from engramix.llm.work import small_batches, stored

CAPACITY = 1024

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first number, end number, first bin, pieces in each bin, offset) and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
    bins = 0

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], taken[length] + pieces, first, each, offset))
        taken[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        partner = next((b for b in reversed(large) if a + b <= capacity and left[b] > (a == b)), None)
        if partner is None:
            m = left[a]
            put(a, m, bins, 1, 0)
        else:
            m = left[a] // 2 if partner == a else min(left[a], left[partner])
            put(a, m, bins, 1, 0)
            put(partner, m, bins, 1, a)
        room = capacity - a - (partner or 0)
        gaps.setdefault(room, []).append((bins, m))
        bins += m
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            room = min((g for g in gaps if g >= s), default=None)
            if room is None:
                each = capacity // s
                m = -(-left[s] // each)
                gaps.setdefault(capacity, []).append((bins, m))
                bins += m
                continue
            first, m = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each = room // s
            full = min(m, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - room)
                gaps.setdefault(room - each * s, []).append((first, full))
            if full < m:
                rest = min(left[s], each)  # below `each`: the last bin that this length reaches
                if rest:
                    put(s, rest, first + full, rest, capacity - room)
                    gaps.setdefault(room - rest * s, []).append((first + full, 1))
                if m - full - (rest > 0) > 0:
                    gaps.setdefault(room, []).append((first + full + (rest > 0), m - full - (rest > 0)))
    return runs, bins


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    vocabulary = vocabulary or public_bpe()
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(t)
                    rows += [(d, k, a, n, zlib.crc32(ids[a : a + n])) for k, (a, n) in enumerate(cut(len(ids), capacity))]
                d, k, a, n, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, _PIECE)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and END; null and empty texts are END alone. Longer documents are cut into pieces of
    `capacity`, the first takes the rest. Sequences are filled from offset 0 without gaps. Rows that repeat an id
    or have none are packed like any other; an empty table gives no rows. vocabulary: encoder()'s arguments."""
    spark = docs.sparkSession
    found = stored(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    # about sqrt(count) salts for each length: as many groups as rows in a group
    salts = [1] * (capacity + 1)
    for n, c in counts.items():
        salts[n] = max(1, round(c**0.5))
    # by the row's place, so repeated rows and null ids are spread too; written once, since places may change
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int") + 1))
    spread = stored(found.withColumn("salt", salt), "salted")
    groups = spread.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = spread.withColumn("k", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("number", F.col("base") + F.col("k"))
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        runs = shared.value
        n, k = length.to_numpy(np.int64), number.to_numpy(np.int64)
        # runs are sorted by length and number; a piece belongs to the last run that doesn't begin after it
        begin = np.array([(a, b) for a, b in runs[:, :2]], dtype=[("n", np.int64), ("k", np.int64)])
        own = np.empty(len(n), begin.dtype)
        own["n"], own["k"] = n, k
        r = runs[np.searchsorted(begin, own, side="right") - 1]
        step = k - r[:, 1]
        return pd.DataFrame({"sequence_id": r[:, 3] + step // r[:, 4], "offset": r[:, 5] + step % r[:, 4] * n})

    return numbered.withColumn("at", place("length", "number")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
