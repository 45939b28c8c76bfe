"""Token-id output: best-fit-decreasing packing with a segment tree over the rooms of open sequences.

Each task packs blocks of about BLOCK_TOKENS tokens on its own, so ids are never shuffled; a block wastes less than
one sequence beyond what its lengths force. Memory is bounded by a block and the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramix.llm.tokens import cut, encoder, public_bpe
from engramix.llm.work import small_batches

CAPACITY = 1024
BLOCK_TOKENS = 4 << 20
#: Fills the row of ids after its last document.
PAD = 0

_PACKED = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, segments array<struct<doc_id:long,piece:int,start:long,length:int>>"


class Rooms:
    """Open sequences by room; a segment tree of counts finds the smallest sufficient room in log2(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) with the smallest room of at least `least`, no longer open; None if there is none."""
        i = least + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.tree[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the lengths that share a sequence, for each sequence, in the order of placing."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            found = capacity, len(out)
            out.append([])
        room, sequence = found
        out[sequence].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], sequence)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """One row for each sequence: sequence_id, n_tokens, input_ids (little-endian unsigned 32-bit, `capacity` of them,
    PAD after n_tokens), cu_seqlens (0 and the end of each segment), position_ids (little-endian unsigned 32-bit,
    from 0 in each segment and in the padding), segments (which tokens of which document, in order).

    Overlong documents are cut into pieces of `capacity` tokens, the first takes the rest; nothing is dropped. Null and
    empty texts are the END id alone; rows that repeat an id or have none are packed like any other; an empty table
    gives no rows. sequence_id is unique; which documents share a sequence depends on the input's partitions."""
    vocabulary = vocabulary or public_bpe()
    small_batches(docs.sparkSession)

    def emit(block: list[tuple[int | None, np.ndarray]], first: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        parts = [(d, k, a, n, ids) for d, ids in block for k, (a, n) in enumerate(cut(len(ids), capacity))]
        bins = best_fit_decreasing([p[3] for p in parts], capacity)
        count = np.arange(capacity, dtype="<u4")
        for lo in range(0, len(bins), 1000):
            rows = []
            for sequence in bins[lo : lo + 1000]:
                ids, pos = np.full(capacity, PAD, "<u4"), np.empty(capacity, "<u4")
                ends = [0]
                for i in sequence:
                    _, _, a, n, whole = parts[i]
                    at = ends[-1]
                    ids[at : at + n] = whole[a : a + n]
                    pos[at : at + n] = count[:n]
                    ends.append(at + n)
                pos[ends[-1] :] = count[: capacity - ends[-1]]
                rows.append((first + len(rows), ends[-1], ids.tobytes(), ends, pos.tobytes(), [{"doc_id": parts[i][0], "piece": parts[i][1], "start": parts[i][2], "length": parts[i][3]} for i in sequence]))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "segments"]), len(rows)
            first += len(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary)
        made = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py())
                block.append((d, ids))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    for out, n in emit(block, made):
                        yield out
                        made += n
                    block, size = [], 0
        for out, _ in emit(block, made):
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, _PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids array<long>) of every segment: the round trip's other half.

    Null and repeated ids come back as they were packed, a row for each segment; an empty table gives no rows; columns
    beyond those of pack() are ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, ends, segments in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                whole = np.frombuffer(ids, "<u4")
                rows += [(s["doc_id"], s["piece"], s["start"], whole[a:b].tolist()) for s, a, b in zip(segments, ends, ends[1:], strict=False)]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["doc_id", "piece", "start", "ids"])

    return packed.select("input_ids", "cu_seqlens", "segments").mapInArrow(read, "doc_id long, piece int, start long, ids array<long>")
