"""Language identification with hyperdimensional profiles.

Every letter of any script has its own random vector of -1 and 1. A trigram's vector binds (multiplies) its letters'
vectors, each rotated by its place; a text's vector bundles (adds) its trigrams' vectors; a language's prototype bundles its
training texts'. The language with the largest cosine wins.

Prototypes are fitted on at most `sample` documents of each language, whole texts; all others are only compared. Trigrams are
counted before they are bundled, in pieces of bounded size.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.llm.kernel import chunks, mix, utf8
from engramix.llm.work import small_batches

DIM = 1024
#: Documents of a language to fit on, at most (those with the smallest hashes).
SAMPLE = 2000
UNKNOWN = "und"
#: Trigrams below which a low cosine doesn't speak against a language.
FEW = 60
_BITS = 21  # of a code point; 0 is a gap between words


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case if it belongs to words (letters and combining marks, otherwise 0), and whether it is a letter."""
    lower, alpha = np.zeros(sys.maxunicode + 1, np.int32), np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            lower[c], alpha[c] = ord(chr(c).lower()[0]), True
        elif kind == "M":
            lower[c] = c
    return lower, alpha


def letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """A row of -1 and 1 for each code point, drawn from the code point alone."""
    words = np.arange(-(-dim // 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        drawn = mix(mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(drawn.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :dim].astype(np.int8) * 2 - 1


def bound(codes: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of trigrams: their letters' vectors, rotated by 2, 1 and 0 places and multiplied."""
    places = np.stack([codes >> 2 * _BITS, codes >> _BITS & (1 << _BITS) - 1, codes & (1 << _BITS) - 1])
    points, at = np.unique(places, return_inverse=True)
    base, at = letter_vectors(points, dim), at.reshape(places.shape)
    out = np.roll(base, 2, 1)[at[0]]
    out *= np.roll(base, 1, 1)[at[1]]
    out *= base[at[2]]
    return out


#: Bytes of a text above which its trigrams are counted in pieces.
_MOST = 8 << 20


def _codes(letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct letters, trigrams as numbers of them, bits of such a number) of a run of letters."""
    seen = np.zeros(int(letter.max(initial=0)) + 1, bool)
    seen[letter] = True
    points = np.flatnonzero(seen)
    bits = max(1, int(len(points) - 1).bit_length())
    number = np.zeros(len(seen), np.int64)
    number[points] = np.arange(len(points))
    small = number[letter]
    return points, small[:-2] << 2 * bits | small[1:-1] << bits | small[2:], bits


def _global(points: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    return points[code >> 2 * bits] << 2 * _BITS | points[code >> bits & mask] << _BITS | points[code & mask]


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """(trigram, count, has a letter) of one long text."""
    chars = text.decode()
    lower, alpha = _letters()
    points = (np.frombuffer(chars[i : i + _MOST].encode("utf-32-le"), np.uint32) for i in range(0, len(chars), _MOST))
    parts, any_ = [], False
    for p in points:
        parts.append(lower[p])
        any_ = any_ or bool(alpha[p].any())
    letter = np.concatenate([np.zeros(1, np.int32), *parts, np.zeros(1, np.int32)])
    letter = letter[np.concatenate([[True], (letter[1:] != 0) | (letter[:-1] != 0)])]
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(letter) - 2, _MOST):
        points_, run, bits = _codes(letter[i : i + _MOST + 2])
        own, n = np.unique(run, return_counts=True)
        code, place = np.unique(np.concatenate([code, _global(points_, own, bits)]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([count, n])).astype(np.int64)
    return code, count, any_


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram, count), sorted by document, and whether each text has a letter. Trigrams run over letters (and
    their marks) with one gap between words and at both ends."""
    if not any(len(t) > _MOST for t in texts):
        return _trigrams(texts)
    each = [_long(t) if len(t) > _MOST else (lambda r: (r[1], r[2], bool(r[3][0])))(_trigrams([t])) for t in texts]
    return np.repeat(np.arange(len(texts)), [len(e[0]) for e in each]), np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]), np.array([e[2] for e in each])


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(b"".join(texts).decode().encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t.decode()) for t in texts], np.int64)
    lower, alpha = _letters()
    letter = lower[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    has = np.zeros(len(texts), bool)
    has[doc[alpha[points]]] = True
    # a gap before and after each document
    at = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.concatenate([at[:-1], at[1:]])
    which = np.concatenate([np.arange(len(texts))] * 2)
    # at equal places the end of one document must precede the beginning of the next: order by (place, document)
    order = np.lexsort((which, edges))
    letter, doc = np.insert(letter, edges[order], 0), np.insert(doc, edges[order], which[order])
    keep = np.ones(len(letter), bool)
    keep[1:] = ~((letter[1:] == 0) & (letter[:-1] == 0) & (doc[1:] == doc[:-1]))
    letter, doc = letter[keep], doc[keep]
    none = np.zeros(0, np.int64)
    if len(letter) < 3:
        return none, none, none, has
    points_, code, bits = _codes(letter)
    own = doc[:-2] == doc[2:]
    code, doc = code[own], doc[:-2][own]
    if not len(code):
        return none, none, none, has
    if 3 * bits + int(doc[-1]).bit_length() < 63:
        key = np.sort(doc << 3 * bits | code)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[new] >> 3 * bits, _global(points_, key[new] & (1 << 3 * bits) - 1, bits), np.diff(np.append(new, len(key))), has
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], _global(points_, code[new], bits), np.diff(np.append(new, len(code))), has


#: Documents and trigrams whose bundles are added at once.
_DOCS, _CODES = 1024, 16384


def bundles(n: int, doc: np.ndarray, code: np.ndarray, count: np.ndarray, dim: int) -> np.ndarray:
    """The sum of each document's trigram vectors; doc is sorted."""
    out = np.zeros((n, dim))
    used, place = np.unique(code, return_inverse=True)
    for lo in range(0, len(used), _CODES):
        vectors = bound(used[lo : lo + _CODES], dim).astype(np.float32)
        own = np.flatnonzero((place >= lo) & (place < lo + _CODES)) if len(used) > _CODES else slice(None)
        d, p, c = doc[own], place[own] - lo, count[own].astype(np.float32)
        if len(d) * 24 > n * len(vectors):  # dense enough for a matrix product
            counts = np.zeros((n, len(vectors)), np.float32)
            counts[d, p] = c
            out += counts @ vectors
        else:
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
            for a, b in zip(at, np.append(at[1:], len(d)), strict=True):
                out[d[a]] += c[a:b] @ vectors[p[a:b]]
    return out


class Profiles(NamedTuple):
    languages: list[str]
    prototypes: np.ndarray  # unit vectors, a row for each language

    def compare(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a text has letters, cosine of its bundle with each prototype, number of its trigrams)."""
        dim = self.prototypes.shape[1]
        doc, code, count, letters = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(texts), _DOCS):
            part = slice(*np.searchsorted(doc, [lo, lo + _DOCS]))
            bundle = bundles(min(_DOCS, len(texts) - lo), doc[part] - lo, code[part], count[part], dim)
            out[lo : lo + _DOCS] = (bundle @ self.prototypes.T) / np.maximum(np.sqrt((bundle**2).sum(1)), 1e-9)[:, None]
        return letters, out, np.bincount(doc, weights=count, minlength=len(texts))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dim: int = DIM) -> Profiles:
    """Prototypes from at most `sample` rows of each language whose crc32(id as text) mod 4 is not 2.

    Rows that repeat id and text count once; null ids, texts and languages take no part. Only a language's name and `dim`
    sums reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null and _id is not null and _text is not null").filter(F.crc32("_id") % 4 != 2).withColumn("_h", F.xxhash64("_id", "_text"))
    # the sample-th smallest hash of a language bounds its rows; only hashes pass through the sort, `sample` of each task and language
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    cuts = {r._lang: r.cut for r in own.select("_lang", "_h").distinct().withColumn("k", rank).filter(F.col("k") <= sample).groupBy("_lang").agg(F.max("_h").alias("cut")).collect()}
    if not cuts:
        return Profiles([], np.zeros((0, dim)))
    cut = F.element_at(F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair)), F.col("_lang"))
    chosen = own.filter(F.col("_h") <= cut).groupBy("_lang", "_h").agg(F.min("_text").alias("_text")).select("_lang", "_text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for first, run in chunks(utf8(batch.column(1))):
                names = sorted(set(languages[first : first + len(run)]))
                number = np.array([names.index(x) for x in languages[first : first + len(run)]])
                doc, code, count, _ = trigrams(run)
                order = np.lexsort((code, number[doc]))
                language, code, count = number[doc][order], code[order], count[order]
                new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (language[1:] != language[:-1])])) if len(code) else np.zeros(0, np.int64)
                sums = bundles(len(names), language[new], code[new], np.add.reduceat(count, new) if len(new) else count, dim)
                for name, bundle in zip(names, sums, strict=True):
                    total[name] = total.get(name, 0) + bundle
        for name, bundle in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim, pa.string()), pa.array(np.arange(dim)), pa.array(bundle.astype(np.int64))], ["lang", "i", "x"])

    languages = sorted(cuts)
    prototypes = np.zeros((len(languages), dim))
    for name, i, x in chosen.mapInArrow(read, "lang string, i long, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        prototypes[languages.index(name), i] = x
    return Profiles(languages, prototypes / np.maximum(1e-9, np.sqrt((prototypes**2).sum(1)))[:, None])


def _judge(profiles: Profiles, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, its cosine, trigrams) of each text."""
    if not profiles.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    letters, near, size = profiles.compare(texts)
    best = near.argmax(1)
    return [profiles.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(near.max(1), 0, 1), 0.0), size


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is the language with the largest cosine (ties: the first by name), `und` for null texts, texts without a
    letter, and when no language was learned; score is that cosine, 0 for `und`. held_out marks ids whose crc32 (as text)
    mod 4 is 2; false for null ids. Repeated rows get the same answer; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(2))):
                names, cosine, _ = _judge(shared.value, run)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), batch.column(1).slice(first, len(run)), pa.array(names, pa.string()), pa.array(cosine)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", languages: list[str] | None = None, least: float = 0.1) -> DataFrame:
    """docs, all columns, without the rows in no language (`und`), in none of `languages`, or with a cosine below `least`,
    which says nothing of texts with fewer than FEW trigrams.

    So null and empty texts and those without a letter go. Repeated rows and null ids are judged row by row, other columns
    aren't looked at; an empty table stays empty, and all rows go if no language was learned."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    column = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(column))):
                names, cosine, size = _judge(shared.value, run)
                keep = [n != UNKNOWN and (languages is None or n in languages) and (c >= least or k < FEW) for n, c, k in zip(names, cosine, size, strict=True)]
                yield batch.slice(first, len(run)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(read, docs.schema)
