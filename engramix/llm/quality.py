"""Quality classifier: a linear-chain conditional random field over a document's lines.

A line is good or bad. Its evidence is the binned shape of the line itself and of its two neighbours (letter case,
symbols, repetition, word lengths, ends of sentences, copies of earlier lines); the chain's transitions tie
neighbouring lines together. Forward-backward marginals, weighted by the lines' lengths, give the share of good text,
and a logistic curve over that share gives the score.

Training sees at most `sample` labelled documents, with whole texts. Labels exist for documents only: lines start with
their document's label; then, in bad documents, lines that the model takes for good are relabelled and it is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.kernel import SPACED, chunks, hash_words, mix, utf8
from engramix.llm.work import small_batches

#: Labelled documents to fit on, at most (those with the smallest hashed ids), and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
THRESHOLD = 0.3

#: Upper ends of the bins of each feature of a line.
_EDGES = {
    "bytes": (8, 20, 40, 80, 160, 320, 640),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "exclaim": (0.001, 0.01, 0.03, 0.08),
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.15, 0.3),
    "digits": (0.001, 0.02, 0.05, 0.15, 0.4),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "distinct": (0.2, 0.4, 0.6, 0.75, 0.9, 0.999),
    "twins": (0.001, 0.05, 0.2, 0.5),
    "stops": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4),
    "last": (0.5, 1.5),
    "first": (0.5, 1.5),
    "copy": (0.5,),
}
_BINS = max(map(len, _EDGES.values())) + 1


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes([*range(97, 123), *range(0x80, 256)]))
_DIGIT, _EXCLAIM = _class(b"0123456789"), _class(b"!")
_SYMBOL = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"))
_STOP = _class(b".?;:")
#: 0 none, 1 other, 2 the end of a sentence; 0 lower or none, 1 other, 2 upper.
_LAST = np.where(_class(b".?!\"')") == 1, 2, np.where(_LOWER + _UPPER == 1, 0, 1))
_FIRST = np.where(_UPPER == 1, 2, np.where(_LOWER == 1, 0, 1))


class Lines(NamedTuple):
    """Lines of a run of documents in order: bins of their features, bytes, and offsets of each document's lines."""

    bins: np.ndarray
    size: np.ndarray
    at: np.ndarray


def lines_of(texts: list[bytes]) -> Lines:
    """The lines with something other than white space of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if not len(texts):
        return Lines(np.zeros((0, len(_EDGES)), np.int8), np.zeros(0, np.int64), np.zeros(1, np.int64))
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    black = np.concatenate([[0], np.cumsum(SPACED.word[buf], dtype=np.int64)])
    full = black[ends] > black[starts]
    starts, ends = starts[full], ends[full]
    at = np.searchsorted(starts, begin)
    size = ends - starts

    def share(kind: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[buf], dtype=np.int32)])
        return (total[ends] - total[starts]) / np.maximum(1, size if of is None else of)

    upper, lower = share(_UPPER), share(_LOWER)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    # words of each line, from the same bytes: a line's words are consecutive
    words, _ = hash_words([buf.tobytes()], SPACED)
    edge = np.diff(SPACED.word[buf].view(np.int8), prepend=np.int8(0))
    word_at = np.searchsorted(np.flatnonzero(edge == 1), np.concatenate([starts, [len(buf)]]))
    count = np.diff(word_at)
    line = np.repeat(np.arange(len(starts)), count)
    # distinct words: sort by (line, word) with the line in the high bits
    key = np.sort(line.astype(np.uint64) << np.uint64(40) | words >> np.uint64(24))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts)) / np.maximum(1, count)
    twin = np.concatenate([[False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])]) if len(words) else np.zeros(0, bool)
    twins = np.bincount(line[twin], minlength=len(starts)) / np.maximum(1, count)
    whole = np.zeros(len(starts), np.uint64)
    if len(words):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + (np.arange(len(words)) - word_at[line]).astype(np.uint64)), dtype=np.uint64)])
        whole = mix(sums[word_at[1:]] - sums[word_at[:-1]])
    order = np.lexsort((np.arange(len(starts)), whole, doc))
    copy = np.zeros(len(starts))
    copy[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    values = {
        "bytes": size,
        "upper": upper / np.maximum(1e-9, upper + lower),
        "exclaim": share(_EXCLAIM),
        "symbols": share(_SYMBOL),
        "digits": share(_DIGIT),
        "word_length": size / np.maximum(1, count),
        "distinct": distinct,
        "twins": twins,
        "stops": share(_STOP, count),
        "last": _LAST[buf[ends - 1]],
        "first": _FIRST[buf[starts]],
        "copy": copy,
    }
    bins = np.stack([np.searchsorted(edges, values[k]) for k, edges in _EDGES.items()], axis=1).astype(np.int8)
    return Lines(bins, size, at)


class Model(NamedTuple):
    """Weights for "good" of (offset -1, 0, 1; feature; bin), bias, transitions [from, to], curve (intercept, slope)."""

    weight: np.ndarray
    bias: float
    move: np.ndarray
    curve: np.ndarray

    @classmethod
    def blank(cls) -> Model:
        return cls(np.zeros((3, len(_EDGES), _BINS)), 0.0, np.zeros((2, 2)), np.zeros(2))


def _evidence(model: Model, lines: Lines) -> np.ndarray:
    columns = np.arange(len(_EDGES))
    score = [w[columns, lines.bins].sum(1) for w in model.weight]
    doc = np.repeat(np.arange(len(lines.at) - 1), np.diff(lines.at))
    out = score[1] + model.bias
    same = doc[1:] == doc[:-1]
    out[1:] += np.where(same, score[0][:-1], 0)
    out[:-1] += np.where(same, score[2][1:], 0)
    return out


def marginals(model: Model, lines: Lines) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions [from, to], log of the partition functions' product)."""
    u = _evidence(model, lines)
    sizes = np.diff(lines.at)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], lines.at[:-1][order]
    forward, backward = np.zeros((len(u), 2)), np.zeros((len(u), 2))
    move = model.move
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max(initial=0)))]  # documents with more than t lines
    for t, m in enumerate(active):
        i = first[:m] + t
        if t:
            before = forward[i - 1]
            forward[i, 0] = np.logaddexp(before[:, 0] + move[0, 0], before[:, 1] + move[1, 0])
            forward[i, 1] = np.logaddexp(before[:, 0] + move[0, 1], before[:, 1] + move[1, 1])
        forward[i, 1] += u[i]
    for t in range(len(active) - 2, -1, -1):
        i = first[: active[t + 1]] + t
        after = backward[i + 1].copy()
        after[:, 1] += u[i + 1]
        backward[i, 0] = np.logaddexp(move[0, 0] + after[:, 0], move[0, 1] + after[:, 1])
        backward[i, 1] = np.logaddexp(move[1, 0] + after[:, 0], move[1, 1] + after[:, 1])
    both = forward + backward
    norm = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - norm)
    doc = np.repeat(np.arange(len(lines.at) - 1), np.diff(lines.at))
    i = np.flatnonzero(doc[1:] == doc[:-1])
    after = backward[i + 1] + np.stack([np.zeros(len(i)), u[i + 1]], 1)
    pairs = np.array([[np.exp(forward[i, a] + move[a, b] + after[:, b] - norm[i]).sum() for b in (0, 1)] for a in (0, 1)])
    return good, pairs, float(norm[lines.at[:-1][np.diff(lines.at) > 0]].sum())


def _fit_chain(lines: Lines, label: np.ndarray, model: Model, rounds: int) -> Model:
    """Adam on the conditional likelihood, with a quadratic penalty."""
    doc = np.repeat(np.arange(len(lines.at) - 1), np.diff(lines.at))
    same = doc[1:] == doc[:-1]
    seen = np.array([[(same & (label[:-1] == a) & (label[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    n = max(1, len(label))
    x = np.concatenate([model.weight.ravel(), [model.bias], model.move.ravel()])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        now = Model(x[:-5].reshape(model.weight.shape), float(x[-5]), x[-4:].reshape(2, 2), model.curve)
        good, pairs, _ = marginals(now, lines)
        rest = label - good
        shifted = [np.append(np.where(same, rest[1:], 0), 0), rest, np.append(0, np.where(same, rest[:-1], 0))]
        pull = np.stack([np.stack([np.bincount(lines.bins[:, f], weights=r, minlength=_BINS) for f in range(len(_EDGES))]) for r in shifted])
        g = np.concatenate([pull.ravel(), [rest.sum()], (seen - pairs).ravel()]) / n - 1e-4 * x
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x + 0.08 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(x[:-5].reshape(model.weight.shape), float(x[-5]), x[-4:].reshape(2, 2), model.curve)


def good_share(model: Model, lines: Lines) -> np.ndarray:
    """Length-weighted mean of P(good) of each document; not a number without lines."""
    good, _, _ = marginals(model, lines)
    part = np.concatenate([[0], np.cumsum(good * lines.size)])
    total = np.concatenate([[0], np.cumsum(lines.size)])
    with np.errstate(invalid="ignore"):
        return (part[lines.at[1:]] - part[lines.at[:-1]]) / (total[lines.at[1:]] - total[lines.at[:-1]])


def _odds(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 0.005, 0.995)
    return np.log(p / (1 - p))


def fit(lines: Lines, label: np.ndarray) -> Model:
    """From documents' lines and labels (1 good, 0 bad)."""
    model = Model.blank()
    keep = np.diff(lines.at) > 0
    if not keep.any():
        return model
    per_line = np.repeat(label, np.diff(lines.at)).astype(float)
    model = _fit_chain(lines, per_line, model, 60)
    if 0 < label[keep].mean() < 1:
        good, _, _ = marginals(model, lines)
        cut = np.quantile(good[per_line == 1], 0.05)
        worst = np.minimum.reduceat(good, lines.at[:-1][keep])  # every bad document keeps a bad line
        worst = np.repeat(worst, np.diff(lines.at)[keep])
        model = _fit_chain(lines, np.where((per_line == 0) & (good >= cut) & (good > worst), 1.0, per_line), model, 40)
    odds, y = _odds(good_share(model, lines)[keep]), label[keep].astype(float)
    x = np.stack([np.ones_like(odds), odds], 1)
    curve = np.zeros(2)
    for _ in range(25):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-x @ curve))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        curve = curve + np.linalg.solve(h, x.T @ (y - p) - 0.5 * curve)
    return model._replace(curve=curve)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    share = good_share(model, lines := lines_of(texts))
    z = model.curve[0] + model.curve[1] * _odds(np.nan_to_num(share, nan=0.5))
    return np.where(np.diff(lines.at) > 0, 1 / (1 + np.exp(-z)), 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample` of the labelled rows whose crc32(id as text) mod 5 is not 0, with whole texts of at most
    `sample_bytes` together (a text that goes beyond is passed over).

    Null ids, labels other than 0 and 1, and labels without a document take no part; of rows that repeat an id the first
    text counts, with each of its labels. Without any label the model scores all texts alike."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)").filter(F.crc32(F.col("_id").cast("string")) % 5 != 0)
    chosen = own.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sizes = texts.join(F.broadcast(chosen.select("_id").distinct()), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n"))
    left, fitting = sample_bytes, []
    for i, n in sizes.orderBy(F.xxhash64("_id"), "_id").collect():  # `sample` rows at most
        if (n or 0) <= left:
            left -= n or 0
            fitting.append((i,))
    chosen = chosen.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, T.StructType([T.StructField("_id", sizes.schema["_id"].dataType)]))), "_id")
    first = texts.join(F.broadcast(chosen.select("_id").distinct()), "_id").groupBy("_id").agg(F.min("_text").alias("_text"))
    rows = first.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(1))):
                lines = lines_of(run)
                cut = [slice(a, b) for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), batch.column(2).slice(first, len(run)), pa.array([lines.bins[c].tobytes() for c in cut], pa.binary()), pa.array([lines.size[c].tobytes() for c in cut], pa.binary())], ["_id", "_label", "bins", "size"])

    found = rows.withColumn("_id", F.col("_id").cast("long")).mapInArrow(read, "_id long, _label int, bins binary, size binary").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))  # the same fit however the rows arrive
    bins = np.frombuffer(b"".join(r.bins for r in found), np.int8).reshape(-1, len(_EDGES))
    size = np.frombuffer(b"".join(r["size"] for r in found), np.int64)
    at = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in found])]).astype(np.int64)
    return fit(Lines(bins, size, at), np.array([r._label for r in found], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    score is the chance that the label is 1; null, empty and blank texts score 0. predicted is 1 if score >= 0.3.
    held_out marks ids whose crc32 (as text) mod 5 is 0; it is false for null ids. Repeated rows are scored alike;
    an empty table gives no rows. Only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(2))):
                s = scores(shared.value, run)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), batch.column(1).slice(first, len(run)), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score below the threshold; so null, empty and blank texts go.

    Repeated rows and null ids are judged row by row, other columns aren't looked at; an empty table stays empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in chunks(utf8(batch.column(column))):
                yield batch.slice(first, len(run)).filter(pa.array(scores(shared.value, run) >= THRESHOLD))

    return docs.mapInArrow(read, docs.schema)
