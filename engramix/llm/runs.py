"""Periodic runs of words, by a scan of all lags.

A text's words become ids, and the ids are compared with themselves shifted by every lag up to half their number (the
least exponent is 2). A stretch of equal ids at lag q is a run of period q. Short lags compare all words. From _EVERY
on, lags go by octaves [Q, 2Q): a stretch that is long enough holds a whole block of Q/2 words, so the first word of
each block is compared with all lags of the octave in one matrix, further words of the block thin out what is equal,
and what is left is compared in full and widened. Texts lie behind each other with ids of their own, so many are
scanned at once.

A stretch of a multiple of a smaller period covers the same words as that period's run; of equal places the smallest
period stays. Texts of more than LONG words are dealt out as ranges of lags with about equal work.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.llm.kernel import chunks, utf8
from engramix.llm.work import small_batches, stored

#: Fewest words of a run, and least length over period.
LEAST, EXPONENT = 12, 2
#: Words of a text that one task scans for all lags; longer texts are dealt out by lags.
LONG = 1 << 13
#: Comparisons of a dealt range of lags.
WORK = 1 << 18
#: Lags below are compared in full.
_EVERY = 16
#: Places of a block, in 256ths, that are compared before all of it.
_PROBES = (255, 128, 64, 192, 32, 96, 160, 224)
#: Comparisons held in memory at once.
_CELLS = 1 << 22

_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in _DIGEST.split(", ")]

Run = tuple[int, int, int]


def _left(ids: np.ndarray, lag: int, at: int) -> int:
    """The first place of the stretch that ends before `at`."""
    step = 64
    while at:
        lo = max(0, at - step)
        differ = np.flatnonzero(ids[lo:at] != ids[lo + lag : at + lag])
        if len(differ):
            return lo + int(differ[-1]) + 1
        at, step = lo, min(4 * step, _CELLS)
    return 0


def _right(ids: np.ndarray, lag: int, at: int) -> int:
    """The end of the stretch that holds the places before `at`."""
    step, end = 64, len(ids) - lag
    while at < end:
        hi = min(end, at + step)
        differ = np.flatnonzero(ids[at:hi] != ids[at + lag : hi + lag])
        if len(differ):
            return at + int(differ[0])
        at, step = hi, min(4 * step, _CELLS)
    return end


def _compared(ids: np.ndarray, lag: int) -> list[Run]:
    """Runs of one lag, all words compared."""
    same = (ids[lag:] == ids[:-lag]).view(np.int8)
    edge = np.diff(same, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= max(LEAST - lag, (EXPONENT - 1) * lag)
    return [(s, e - s + lag, lag) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]


class _Known:
    """Runs found so far, by period; those of one period begin and end in the same order."""

    def __init__(self, runs: list[Run]) -> None:
        by: dict[int, list[tuple[int, int]]] = {}
        for s, n, p in runs:
            by.setdefault(p, []).append((s, s + n))
        self.by = {p: np.array(sorted(places)).T for p, places in by.items()}

    def covers(self, first: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Where a run, of a period that divides the lag, holds all of [first, end)."""
        out = np.zeros(len(first), bool)
        for p, (starts, ends) in self.by.items():
            i = np.flatnonzero(lag % p == 0)
            k = np.searchsorted(starts, first[i], side="right") - 1
            out[i] |= (k >= 0) & (ends[np.maximum(k, 0)] >= end[i])
        return out


def _octave(ids: np.ndarray, low: int, high: int, known: _Known) -> list[Run]:
    """Runs of the lags in [low, high), high <= 2 low, that aren't multiples of known ones."""
    block = (low + 1) // 2
    anchors = np.arange(0, len(ids) - low - block + 1, block)
    if not len(anchors):
        return []
    width = high - low
    padded = np.concatenate([ids, np.full(high + block, -1, ids.dtype)])
    shifted = np.lib.stride_tricks.sliding_window_view(padded, width)
    found: list[Run] = []
    for lo in range(0, len(anchors), max(1, _CELLS // width)):
        own = anchors[lo : lo + max(1, _CELLS // width)]
        row, column = np.nonzero(shifted[own + low] == ids[own][:, None])
        first, lag = own[row], low + column
        for probe in _PROBES:
            at = first + block * probe // 256
            equal = padded[at] == padded[at + lag]
            first, lag = first[equal], lag[equal]
        new = ~known.covers(first, first + block + lag, lag)
        order = np.lexsort((first[new], lag[new]))
        done = 0, 0  # the lag and the end of the stretch seen last
        for c, q in zip(first[new][order].tolist(), lag[new][order].tolist(), strict=True):
            if (done[0] == q and c < done[1]) or not np.array_equal(ids[c : c + block], ids[c + q : c + q + block]):
                continue
            start, end = _left(ids, q, c), _right(ids, q, c + block)
            done = q, end
            if end - start >= (EXPONENT - 1) * q:
                found.append((start, end - start + q, q))
    return found


def scan(ids: np.ndarray, low: int = 1, high: int | None = None) -> list[Run]:
    """(start, length, period) by start and period: the runs among ids (not negative) whose period is in [low, high); a run of a
    smaller period, outside the range, may come with a multiple of it too."""
    high = min(high or len(ids), len(ids) // EXPONENT + 1)
    best: dict[tuple[int, int], int] = {}

    def add(runs: list[Run]) -> None:
        for s, n, p in runs:
            best[s, n] = min(p, best.get((s, n), p))

    for lag in range(low, min(high, _EVERY)):
        add(_compared(ids, lag))
    lag = max(low, _EVERY)
    while lag < high:
        add(_octave(ids, lag, min(2 * lag, high), _Known([(s, n, p) for (s, n), p in best.items()])))
        lag = min(2 * lag, high)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def ranges(n: int, work: int = WORK) -> list[tuple[int, int]]:
    """Ranges of lags of a text of n words, with about `work` comparisons in each."""
    high = n // EXPONENT + 1
    out, low, spent = [], 1, 0
    lag = 1
    while lag < high:
        cost = n if lag < _EVERY else 2 * n // (1 << (lag.bit_length() - 1)) + 1
        top = lag + 1 if lag < _EVERY else min(high, 1 << lag.bit_length(), lag + max(1, (work - spent) // cost))
        spent += cost * (top - lag)
        lag = top
        if spent >= work or lag == high:
            out.append((low, lag))
            low, spent = lag, 0
    return out


def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
    """The text's words; where the id's CRC-32 is a multiple of ten, words from a place on repeat a few of themselves."""
    words = text.split()
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + list(itertools.islice(itertools.cycle(tail), len(words) - a))


def _ids(words: list[bytes], base: int = 0) -> np.ndarray:
    """The place of each word's first use, plus base."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, range(base, base + len(words))), np.int64, len(words))


def _digest(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    if runs:
        keep = np.ones(len(words), bool)
        for s, n, p in runs:
            keep[s + p : s + n] = False
        words = list(itertools.compress(words, keep.tolist()))
        s, n, p = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
        top = s, n, p, 1000 * n // p
    else:
        top = (None,) * 4
    return (doc_id, len(runs), *top, listed, hashlib.sha256(b" ".join(words)).hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    columns = zip(*rows, strict=True) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def _here(docs: DataFrame, longest: int) -> DataFrame:
    """Digests of the rows of at most `longest` words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(1))):
                texts = [(i, w) for i, t in zip(batch.column(0).slice(first, len(run)).to_pylist(), run, strict=True) if len(w := words_of(i, t)) <= longest]
                if not texts:
                    continue
                at = np.concatenate([[0], np.cumsum([len(w) for _, w in texts])])
                ids = np.concatenate([_ids(w, int(b)) for (_, w), b in zip(texts, at, strict=False)])
                own: list[list[Run]] = [[] for _ in texts]
                for s, n, p in scan(ids, high=max(len(w) for _, w in texts) // EXPONENT + 1):
                    k = int(np.searchsorted(at, s, side="right")) - 1
                    own[k].append((s - int(at[k]), n, p))
                yield _batch([_digest(i, w, runs) for (i, w), runs in zip(texts, own, strict=True)])

    return docs.mapInArrow(read, _DIGEST)


def _dealt(docs: DataFrame, longest: int, work: int) -> DataFrame:
    """Digests of the rows of more than `longest` words, whose lags are scanned by many tasks."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if len(t.split()) > longest:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int64()), pa.array([t.decode()])], ["key", "doc_id", "text"])
                    key += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                ids = _ids(words_of(i, t)).astype(np.int32 if len(t) < 1 << 31 else np.int64).tobytes()
                for low, high in ranges(len(ids) // (4 if len(t) < 1 << 31 else 8), work):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([low]), pa.array([high]), pa.array([4 if len(t) < 1 << 31 else 8], pa.int32()), pa.array([ids], pa.binary())], ["key", "low", "high", "width", "ids"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, low, high, width, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                runs = scan(np.frombuffer(ids, np.int32 if width == 4 else np.int64), low, high)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(runs), pa.int64()), *(pa.array([r[k] for r in runs], pa.int64()) for k in range(3))], ["key", "start", "length", "period"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, runs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                yield _batch([_digest(i, words_of(i, t), [(r["start"], r["length"], r["period"]) for r in runs or []])])

    # n words need 2 n - 1 bytes, so that most texts are left out before they reach Python
    many = docs.filter(F.octet_length("text") > 2 * longest)
    texts = stored(many.mapInArrow(pick, "key long, doc_id long, text string"), "long_texts")
    parts = texts.mapInArrow(deal, "key long, low long, high long, width int, ids binary").repartition("key", "low")
    found = parts.mapInArrow(find, "key long, start long, length long, period long")
    best = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    # fewer runs than words, so a text's runs are no larger than the text
    listed = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return texts.join(listed, "key", "left").select("doc_id", "text", "runs").mapInArrow(digest, _DIGEST)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONG, work: int = WORK) -> DataFrame:
    """One row for each row of docs: doc_id, n_runs, the longest run (ties: the smallest start, then period; null without runs) as
    start, length, period and exponent_milli, and hashes of the list of runs and of the text without their repetitions.

    Words are numbered from 0; a run is a stretch of LEAST words or more, and of two periods or more, that no neighbouring
    word extends. Null and empty texts have no words and no runs; words of rows without an id aren't rewritten; rows that
    repeat an id are digested one by one; an empty table gives no rows. Other columns aren't looked at. longest: words of a
    text that one task scans for all lags; work: comparisons in each range of lags of longer ones."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _here(own, longest).unionByName(_dealt(own, longest, work))
