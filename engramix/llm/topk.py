"""Exact top-k by integer inner product with a pivot table.

Vectors x get one more component, sqrt(M^2 - |x|^2) for the largest squared length M^2, and queries a zero there; then
a larger inner product is a smaller distance, score = (|q|^2 + M^2 - distance^2) / 2. Distances of every vector to a
fixed set of pivots are computed once and stored with it. For a query, |d(q, p) - d(x, p)| bounds d(q, x) from below for
each pivot p; the largest such bound gives an upper bound of the score. Candidates are scored in the order of their
bounds until the next bound is below the k-th score found; the result is exact. The order is kept in two steps for each
block of candidates: those with the best bounds while a query has no k scores yet, then all whose bounds reach the k-th
score; where these are more than a fifth of a block, one matrix product scores them.

Candidates stay where they are: the queries come to them, in passes of bounded size, and each task keeps the best k of
each query over all its candidates. So vectors are shuffled once, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.llm.work import small_batches, stored

K, SCALE, PIVOTS = 20, 64, 16
#: Rows of a block of candidates, and queries compared with it at once.
CANDIDATES, QUERIES = 4096, 256
#: Candidates of a query and block that are scored first, or twice k where that is more.
STEP = 256
#: Bytes of query vectors that are broadcast in a pass.
PASS_BYTES = 16 << 20
#: Candidates of a task, on average, where there are many.
SHARE = 1 << 18

_BLOCK = "ids binary, vectors binary, extra binary, pivots binary"
_QUERY = "ids binary, vectors binary, pivots binary"
_SCORED = "query_id long, vec_id long, score long"


def _padded(rows: list[list[float] | None], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _product(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact integer a @ b.T; wide: sums may be beyond the integers that doubles hold."""
    return a.astype(np.int64) @ b.astype(np.int64).T if wide else a @ b.T


def _full(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of CANDIDATES rows each, the last ones of a task aside, however many rows a batch has."""
    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for lo in range(0, len(batch), CANDIDATES):
            part = batch.slice(lo, CANDIDATES)
            ids.append(part.column(0).to_numpy().astype(np.int64))
            parts.append(_padded(part.column(1).to_pylist(), dim))
            held += len(part)
            if held >= CANDIDATES:
                i, x = np.concatenate(ids), np.concatenate(parts)
                yield i[:CANDIDATES], x[:CANDIDATES]
                ids, parts, held = [i[CANDIDATES:]], [x[CANDIDATES:]], held - CANDIDATES
    if held:
        yield np.concatenate(ids), np.concatenate(parts)


def _blocks(vectors: DataFrame, dim: int, pivots: np.ndarray, longest: float, kind: str) -> DataFrame:
    """vectors (id, v) in blocks of at most CANDIDATES rows with their distances to the pivots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _full(batches, dim):
            square = (x * x).sum(1)
            extra = np.sqrt(np.maximum(0, longest - square))
            far = np.sqrt(np.maximum(0, square[:, None] + extra[:, None] ** 2 + (pivots**2).sum(1) - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])))
            yield _binary(_BLOCK, ids, x.astype(kind), extra, far.astype(np.float32))

    return vectors.mapInArrow(read, _BLOCK)


def _binary(schema: str, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], [c.split()[0] for c in schema.split(", ")])


def _flat(dim: int, pivots: np.ndarray, kind: str):
    """Queries with their distances to the pivots, with a last component of 0; so these differ from those as a candidate."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _padded(batch.column(1).to_pylist(), dim)
            d = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (pivots**2).sum(1) - 2 * v @ pivots[:, :-1].T))
            yield _binary(_QUERY, batch.column(0).to_numpy().astype(np.int64), v.astype(kind), d.astype(np.float32))

    return read


def _best(top: np.ndarray, q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all that may be among a query's best k, given the bounds and its k-th score so far.

    floor is raised in place. The candidates with the best bounds are scored first; then those whose bounds reach the
    k-th score that they gave. A candidate that is left out has a bound, and so a score, below it."""
    n = top.shape[1]
    step = max(STEP, 2 * k)
    if n > 4 * step and not np.isfinite(floor).all():
        first = np.argpartition(-top, step, axis=1)[:, :step]
        s = np.stack([_product(q[i : i + 1], x[first[i]], wide)[0] for i in range(len(q))]).astype(np.float64)
        s[np.take_along_axis(top, first, 1) == -np.inf] = -np.inf
        np.maximum(floor, np.partition(s, step - k, axis=1)[:, step - k], out=floor)
    open_ = (top >= floor[:, None]) & (top > -np.inf)
    # exact integers either way; comparing wide ones with the float floor can only keep more
    none = np.iinfo(np.int64).min if wide else -np.inf
    scores = np.full(top.shape, none, np.int64 if wide else np.float64)
    if open_.mean() > 0.2:
        np.copyto(scores, _product(q, x, wide), where=open_)
    else:
        for i in np.flatnonzero(open_.any(1)):
            j = np.flatnonzero(open_[i])
            scores[i, j] = _product(q[i : i + 1], x[j], wide)[0]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        np.maximum(floor, np.where(kth > none, kth.astype(np.float64), -np.inf), out=floor)
    i, j = np.nonzero((scores >= floor[:, None]) & (scores > none))
    return i, j, scores[i, j]


def _merged(held: tuple[np.ndarray, np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the best k of each query, ties to the smaller id."""
    i, ids, score = (np.concatenate(c) for c in zip(held, new, strict=True))
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
    return i[keep], ids[keep], score[keep]


def _search(asked, k: int, dim: int, longest: float, wide: bool, kind: str):
    """Over blocks of candidates: the best k of each broadcast query among them all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, pq = asked.value
        square = (q.astype(np.float64) ** 2).sum(1)
        slack = 1e-9 * (longest + square.max(initial=0) + 1)
        floor = np.full(len(qids), -np.inf)
        none = np.zeros(0, np.int64)
        best = [(none, none, none)] * -(-len(qids) // QUERIES)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.float64)
                px = np.ascontiguousarray(np.frombuffer(row["pivots"], np.float32).reshape(len(ids), -1).T)
                for n, lo in enumerate(range(0, len(qids), QUERIES)):
                    part = slice(lo, lo + QUERIES)
                    low = np.zeros((len(qids[part]), len(ids)), np.float32)
                    gap = np.empty_like(low)
                    for p in range(len(px)):
                        np.subtract(pq[part, p, None], px[None, p], out=gap)
                        np.abs(gap, out=gap)
                        np.maximum(low, gap, out=low)
                    # the float32 bound is lowered by more than its rounding
                    low = np.maximum(0, low * np.float32(1 - 1e-5) - np.float32(1e-5 * (1 + np.sqrt(longest))))
                    top = (square[part, None] + longest - low.astype(np.float64) ** 2) / 2 + slack
                    top[ids[None, :] == qids[part, None]] = -np.inf
                    i, j, found = _best(top, q[part].astype(np.float64), x, floor[part], k, wide)
                    if len(i):
                        best[n] = _merged(best[n], (i, ids[j], found.astype(np.int64)), k)
                        own, _, score = best[n]
                        size = np.bincount(own, minlength=len(low))
                        full = np.flatnonzero(size == k)
                        floor[lo + full] = np.maximum(floor[lo + full], score[np.cumsum(size)[full] - 1])
        for n, (i, ids, score) in enumerate(best):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(qids[n * QUERIES + i]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return read


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """For each row of queries the k rows of vectors with the largest integer inner products:
    (query_id long, rank int, vec_id long, score long), ties to the smaller vec_id.

    Components count as floor(scale * x). A query's own id is no candidate. Rows with a null id or vector, or with a
    null or non-finite component, take no part; shorter vectors count as padded with zeros; an id given in several
    query rows is answered once, for the smallest of its vectors, and repeated candidate rows count one by one. Empty tables give no rows.

    A task holds PASS_BYTES of queries, their best k and a block of candidates; more queries take several passes over the
    candidates. The pivots are a bounded sample (n_pivots rows with the smallest hashed ids)."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    small_batches(vectors.sparkSession)
    of = lambda df: df.filter(fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    x, q = of(vectors), of(queries).groupBy("id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    nothing = "query_id long, rank int, vec_id long, score long"
    bound = [F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.count("*")]
    dim, longest, widest, n = x.agg(*bound).first()
    dim_q, longest_q, widest_q, n_asked = q.agg(*bound).first()
    if not n or not n_asked:
        return spark.createDataFrame([], nothing)
    dim, longest, widest = max(1, dim, dim_q), float(max(longest, longest_q)), max(widest or 0.0, widest_q or 0.0)
    wide = widest * widest * dim >= 2**52
    kind = "<f4" if widest < 2**24 else "<f8"  # exact either way
    sample = x.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    p = _padded([r.v for r in sample], dim)
    pivots = np.hstack([p, np.sqrt(np.maximum(0, longest - (p * p).sum(1)))[:, None]])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARE))
    candidates = stored(_blocks(x, dim, pivots, longest, kind).repartition(tasks), "blocks")
    passes = -(-n_asked * dim * 8 // PASS_BYTES)
    found = None
    for turn in range(passes):
        own = q if passes == 1 else q.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(passes)) == turn)
        rows = own.mapInArrow(_flat(dim, pivots, kind), _QUERY).collect()  # about PASS_BYTES
        if not rows:
            continue
        parts = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, kind).reshape(-1, dim), np.frombuffer(r.pivots, np.float32).reshape(-1, len(p))) for r in rows]
        asked = spark.sparkContext.broadcast(tuple(np.concatenate(c) for c in zip(*parts, strict=True)))
        scored = candidates.mapInArrow(_search(asked, k, dim, longest, wide, kind), _SCORED)
        if passes > 1:
            scored = stored(_ranked(scored, k), "best")
            asked.unpersist()
        found = scored if found is None else found.unionByName(scored)
    return (_ranked(found, k) if passes == 1 else found).select("query_id", "rank", "vec_id", "score")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


#: DuckDB SQL for the query: every stated query against every vector.
ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""
