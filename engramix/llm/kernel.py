"""Vectorised byte kernels: word hashing and shingle hashing over whole batches of texts.

A batch of UTF-8 texts is joined with spaces and handled as one uint8 array. A word's 64-bit hash is a
polynomial over per-byte random values, taken from prefix sums, then mixed; no per-word Python work is done.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes in a segment: powers are taken of the position in it.
_SEGMENT = 1 << 16
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SEGMENT - 1, _MULT)]), dtype=np.uint64)
_IPOW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SEGMENT - 1, _INV)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> _SHIFTS[0])) * _MIX_A
    x = (x ^ (x >> _SHIFTS[1])) * _MIX_B
    return x ^ (x >> _SHIFTS[2])


class WordClass:
    """Which bytes form words (A-Z count as a-z)."""

    def __init__(self, is_word: np.ndarray, seed: int) -> None:
        self.word = is_word
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        value[65:91] = value[97:123]
        self.value = value


def _not_space() -> np.ndarray:
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def _alphanumeric() -> np.ndarray:
    """Digits, letters after lower-casing, and every byte of a non-ASCII character."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


SPACED = WordClass(_not_space(), 11)
ALNUM = WordClass(_alphanumeric(), 29)


#: Bytes hashed at once; longer texts are taken in pieces that end between words.
_MOST = 8 << 20


def _pieces(text: bytes, kind: WordClass) -> Iterator[bytes]:
    lo = 0
    while len(text) - lo > _MOST:
        gaps = np.flatnonzero(~kind.word[np.frombuffer(text, np.uint8, _MOST, lo)])
        if len(gaps):
            hi = lo + int(gaps[-1]) + 1
        else:  # a word longer than that stays whole
            rest = np.flatnonzero(~kind.word[np.frombuffer(text, np.uint8, offset=lo)])
            hi = lo + int(rest[0]) + 1 if len(rest) else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def hash_words(texts: Sequence[bytes], kind: WordClass) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in order, offsets of each text's words; len(texts) + 1 of them).

    A word's hash doesn't depend on its place, so texts of any length are hashed in bounded memory beside the hashes."""
    if any(len(t) > _MOST for t in texts):
        parts = [[_hash_words([p], kind)[0] for p in _pieces(t, kind)] for t in texts]
        return np.concatenate([h for hs in parts for h in hs]), np.concatenate([[0], np.cumsum([sum(map(len, hs)) for hs in parts])])
    return _hash_words(texts, kind)


def _hash_words(texts: Sequence[bytes], kind: WordClass) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    inside = kind.word[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = kind.value[buf]
    whole = len(buf) // _SEGMENT * _SEGMENT
    sums[:whole].reshape(-1, _SEGMENT)[:] *= _POW
    sums[whole:] *= _POW[: len(buf) - whole]
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0)) if len(starts) else np.zeros(0, np.uint64)
    h = (sums[ends - 1] - before) * _IPOW[starts % _SEGMENT]
    for i in np.flatnonzero(starts // _SEGMENT != (ends - 1) // _SEGMENT):  # the few words over a segment's end
        own = kind.value[buf[starts[i] : ends[i]]]
        scale = np.uint64(1)
        total = np.uint64(0)
        for lo in range(0, len(own), _SEGMENT):
            part = own[lo : lo + _SEGMENT]
            with np.errstate(over="ignore"):
                total += (part * _POW[: len(part)]).sum(dtype=np.uint64) * scale
                scale *= _POW[-1] * _MULT
        h[i] = total
    return mix(h + (ends - starts).astype(np.uint64) * _MIX_B), np.searchsorted(starts, begins)


_COEF = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (k <= 64)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _COEF[j]
    return mix(out)


def shingle_sets(texts: Sequence[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words: the whole sequence as one; none: empty."""
    words, at = hash_words(texts, SPACED)
    runs = combine(words, k)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield combine(words[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def chunks(texts: Sequence[bytes | None], limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) runs of at most about limit bytes; null counts as empty."""
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as bytes objects, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
