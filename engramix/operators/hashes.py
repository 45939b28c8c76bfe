"""Words of whole batches of texts as 64-bit hashes, in numpy over the texts' bytes; A-Z count as a-z."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX_A, _MIX_B, _SEED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes read at once; a longer word is taken whole. Longer words than so many bytes are hashed one by one.
PIECE, LONG = 1 << 18, 256
#: Bytes of texts whose hashes a batch holds, unless one text has more.
BATCH = 1 << 22
_TOP = np.uint64(1 << 63)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _word_bytes(others: bool, *ranges: range) -> bytes:
    inside = {b for r in ranges for b in r}
    return bytes((b in inside) != others for b in range(256))


#: For each byte 1 if it is part of a word: between white space, as \s+ splits it; a term of functions.text.term_text(); always.
SPACED, TERMS, WHOLE = _word_bytes(True, range(0x20, 0x21), range(0x09, 0x0E)), _word_bytes(False, range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)), bytes([1]) * 256


def _pieces(inside: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end where no word goes on."""
    lo = 0
    while lo < len(inside):
        hi = lo + PIECE
        while hi < len(inside):
            back = inside[lo:hi][::-1].argmin()  # bytes of a word at the end, unless all are
            gap = hi - int(back) if not inside[hi - 1 - back] else lo
            cut = max(gap, int(begins[np.searchsorted(begins, hi, "right") - 1]))  # or the last text that begins by then
            if cut > lo:
                hi = cut
                break
            hi += hi - lo
        hi = min(hi, len(inside))
        yield lo, hi
        lo = hi


def _hash(buf: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Eight bytes after the other of each word. buf goes on for eight bytes."""
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    out = _mixed(sizes.astype(np.uint64) * _SEED)
    own, at, left = np.arange(len(starts)), starts, sizes
    while len(own):
        out[own] = _mixed((out[own] ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * _SEED)
        more = (left > 8) & (sizes[own] <= LONG)
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return out


def hashed(column: pa.Array, word: bytes, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, offsets of each text's) of words of at least so many characters. word: which
    bytes form words."""
    at = _offsets(column)
    begins = at - at[0]
    whole = column.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b""
    word_bytes = np.frombuffer(whole.translate(word), bool)
    out, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(word_bytes, begins):
        own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)] - lo
        inside = word_bytes[lo:hi]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[own] |= inside[own]
        last[own[own > 0] - 1] |= inside[own[own > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        sizes = ends - starts + 1
        if least > 1:
            chars = sizes
            buf = np.frombuffer(whole, np.uint8)[lo:hi]
            if buf.max() >= 0x80:
                upto = np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32)
                chars = upto[ends] - upto[starts] + 1
            starts, sizes = starts[chars >= least], sizes[chars >= least]
        out.append(_hash(whole[lo:hi].translate(_LOWER) + bytes(8), starts, sizes))
        places.append(starts + lo)
    return np.concatenate(out).view(np.int64), np.searchsorted(np.concatenate(places), begins)


def in_lists(batches: Iterator[pa.RecordBatch], columns: list[str], word: bytes, least: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of texts (id, columns) with the hashes of their words in place of the texts, a few MB at a time."""
    for batch in batches:
        ends = sum(np.diff(_offsets(batch.column(c))) for c in columns).cumsum()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, "right")))
            part = batch.slice(lo, hi - lo)
            lists = []
            for c in columns:
                words, at = hashed(part.column(c), word, least)
                lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words)))
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", *columns])
            lo = hi


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def coded(column: pa.Array) -> pa.Array:
    """Lists of any depth of terms, a hash in place of each."""
    if isinstance(column, (pa.ListArray, pa.LargeListArray)):
        first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
        return type(column).from_arrays(pa.array(column.offsets.to_numpy() - first, column.offsets.type), coded(column.values.slice(first, last - first)))
    return pa.array(hashed(column, WHOLE)[0])


class Known:
    """Places of hashes in a sorted array of different ones, by their first bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(1, int(len(known)).bit_length() + 1)
        self._shift = np.uint64(64 - bits)
        self._start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(self._bucket(known), minlength=1 << bits), out=self._start[1:])

    def _bucket(self, words: np.ndarray) -> np.ndarray:
        return ((words.view(np.uint64) ^ _TOP) >> self._shift).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it isn't known."""
        out = np.full(len(words), -1, np.int32)
        bucket = self._bucket(words)
        at, end = self._start[bucket], self._start[bucket + 1]
        live = np.flatnonzero(at < end)
        at, end, words = at[live], end[live], words[live]
        while len(live):
            hit = self.known[at] == words
            out[live[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            live, at, end, words = live[more], at[more] + 1, end[more], words[more]
        return out
