"""Target-distribution importance resampling with hashed word n-grams.

Features are the runs of one to three consecutive words of a text; a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo BUCKETS. A bucket's gain is the log ratio of its share in the target texts to its share in the documents, and a
document's weight is the sum of its features' gains. Gumbel noise from a hash of the id is added, and the highest sums
are drawn, so that documents are drawn without replacement in proportion to their importance.

Words and hashes come from a byte automaton over the Arrow buffer of a batch: a table classifies all bytes, words begin
and end where the classes differ, and the CRC's states of all words advance together, a byte of each at a time; the
state after a word goes on over a space and the next word, so that a run's hash costs its last word only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.kernel import ALNUM
from engramix.llm.work import small_batches, stored

BUCKETS = 10_000
#: Words in the longest feature.
LONGEST = 3
#: Fewest words of a document that may be drawn, and how many of a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42

#: The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    """The CRC's next state for each byte that leaves the register."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return out.astype(np.uint32)


_NEXT = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_START = np.uint32(0xFFFFFFFF)
#: Bytes of a word that all words advance over together; the rest of a longer word is hashed on its own.
_TOGETHER = 64
#: Words whose states are advanced at once, and bytes that are classified at once.
_BLOCK, _RUN = 1 << 17, 4 << 20


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length) of each word of texts that lie one after the other in data, and the offsets of each text's words.

    offsets: the texts' first bytes and the last one's end. A text's border ends a word."""
    inside = ALNUM.word[data].view(np.int8)
    opens = np.diff(inside, prepend=np.int8(0)) == 1
    closes = np.diff(inside, append=np.int8(0)) == -1
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first] = inside[first] == 1
    closes[last] = inside[last] == 1
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts, np.searchsorted(starts, offsets)


def _over(state: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return _NEXT[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The states after each word's bytes, all words together; the longest come first, so those still running lead."""
    together = np.minimum(lengths, _TOGETHER).astype(np.uint8)
    order = np.argsort(_TOGETHER - together, kind="stable")
    running = len(order) - np.cumsum(np.bincount(together, minlength=_TOGETHER + 1))
    now, at = state[order], starts[order]
    for j in range(_TOGETHER):
        m = running[j]
        if not m:
            break
        now[:m] = _over(now[:m], data[at[:m] + j])
    out = np.empty_like(now)
    out[order] = now
    for i in np.flatnonzero(lengths > _TOGETHER):
        rest = data[starts[i] + _TOGETHER : starts[i] + lengths[i]]
        out[i] = zlib.crc32(rest.tobytes(), int(out[i] ^ _START)) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first word, buckets of the features of 1, 2, ... LONGEST words) of blocks of words. A feature belongs to
    its first word; those that would go beyond a text hold -1. last: for each word the index of the end of its text's words."""
    for lo in range(0, len(starts), _BLOCK):
        hi = min(lo + _BLOCK, len(starts))
        own = np.arange(lo, hi)
        out, state = [], np.full(hi - lo, _START)
        for k in range(LONGEST):
            live = np.flatnonzero(own + k < last[lo:hi])
            if k:
                state[live] = _over(state[live], np.uint8(0x20))
            state[live] = advance(state[live], data, starts[own[live] + k], lengths[own[live] + k])
            bucket = np.full(hi - lo, -1, np.int64)
            bucket[live] = (state[live] ^ _START) % np.uint32(BUCKETS)
            out.append(bucket)
        yield lo, out


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, lower-cased bytes, offsets) of runs of about _RUN bytes of a string column; null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, bytes_ = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(bytes_, np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + _RUN, side="right")) - 1)
        end = min(end, len(column))
        yield first, _LOWER[whole[at[first] : at[end]]], at[first : end + 1] - at[first]
        first = end


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all whole texts in each bucket that holds any. A task hands BUCKETS sums on at most."""
    small_batches(texts.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in _runs(batch.column(0)):
                starts, lengths, at = words_in(data, offsets)
                for _, found in features(data, starts, lengths, np.repeat(at[1:], np.diff(at))):
                    for bucket in found:
                        total += np.bincount(bucket + 1, minlength=BUCKETS + 1)
        held = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[1:][held])], ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(read, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares in the target and in docs, rounded down.

    The driver receives BUCKETS sums of either side at most, whatever the size of the texts."""
    sides = []
    for texts, column in ((docs, text_col), (target, target_col)):
        n = np.zeros(BUCKETS, np.int64)
        for bucket, count in bucket_counts(texts, column).collect():
            n[bucket] = count
        sides.append(n)
    s, t = sides
    of_docs, of_target = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_docs / ((a + 1.0) * of_target))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs: the sum of its features' gains. Null and empty texts have
    no features and weigh 0; repeated rows weigh alike; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gain, 0))  # -1 points at the 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in _runs(batch.column(1)):
                starts, lengths, at = words_in(data, offsets)
                n = np.diff(at)
                before = np.zeros(len(starts) + 1, np.int64)
                for lo, found in features(data, starts, lengths, np.repeat(at[1:], n)):
                    before[lo + 1 : lo + 1 + len(found[0])] = sum(shared.value[bucket] for bucket in found)
                np.cumsum(before, out=before)
                count = sum(np.maximum(n - k, 0) for k in range(LONGEST))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(before[at[1:]] - before[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "doc_id long, n_words long, n_features long, weight long")


def noise(row_id: Column) -> Column:
    """A thousand times Gumbel noise from the id's hash, rounded down; ids that are null share one value."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (null where the row isn't drawn).

    Of the N rows with LEAST_WORDS words or more the floor(PERCENT * N / 100) highest scores are drawn, ties to the smaller
    id (null ids first); rows that repeat an id are ranked one by one, in any order. Null and empty texts weigh 0 and aren't
    drawn. Without a target all gains follow from empty counts; an empty table gives no rows. Other columns aren't looked at.

    Ranks come from a sort by ranges: each range numbers its own rows, and the ranges' sizes (one number of each range) are
    added up, so no task sees more than a range."""
    spark = docs.sparkSession
    weighed = weights(docs, gains(docs, target, text_col, target_col), id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = stored(weighed.withColumn("row", F.monotonically_increasing_id()), "scored")  # a row's number must stay
    able = scored.filter(F.col("n_words") >= LEAST_WORDS)
    ordered = able.orderBy(F.desc("score"), "doc_id", "row").withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered, "ordered").withColumn("part", F.shiftright("place", 33))
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each task of the sort
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = spark.createDataFrame(starts, T.StructType([T.StructField("part", T.LongType()), T.StructField("before", T.LongType())]))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.when(rank <= PERCENT * total // 100, rank)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ordered.join(F.broadcast(before), "part").select(*columns, drawn.alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank")))


_ORACLE_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_ORACLE_STEP = f"CASE WHEN {{0}} & 1 = 1 THEN xor({{0}} >> 1, {_POLYNOMIAL}) ELSE {{0}} >> 1 END"
#: DuckDB SQL for resample(documents, benchmark): CRC-32 byte by byte of each distinct feature.
ORACLE = f"""
WITH steps AS (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda s, i: {_ORACLE_STEP.format("s")}) AS v FROM range(256) t(b)),
crc_table AS (SELECT list(v ORDER BY b) AS nexts FROM steps),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_ORACLE_WORDS} AS w FROM documents),
items AS (SELECT {_ORACLE_WORDS} AS w FROM benchmark),
runs AS (
  SELECT row, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)
  UNION ALL SELECT NULL, array_to_string(w[i:i + k - 1], ' ') FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
counted AS (SELECT row, g, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (SELECT g, list_transform(range(1, CAST(strlen(g) AS BIGINT) + 1), lambda i: CAST('0x' || hex(encode(g))[2 * i - 1:2 * i] AS BIGINT)) AS bs FROM (SELECT DISTINCT g FROM counted)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda s, b: xor(s >> 8, nexts[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc_table),
placed AS (SELECT row, bucket, n FROM counted JOIN hashed USING (g)),
sums AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE row IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (WHERE row IS NULL), 0) AS t FROM range({BUCKETS}) r(b) LEFT JOIN placed ON bucket = b GROUP BY 1),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gained AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain FROM sums, totals),
weighed AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM placed JOIN gained USING (bucket) WHERE row IS NOT NULL GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (row)),
ranked AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM ranked
"""
