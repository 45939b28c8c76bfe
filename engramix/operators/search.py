"""Retrieval and ranking: inverted index, BM25, vector search, fusion, de-duplication, re-ranking.

All operators take a frame of queries (query_id, query), so one query is a one-row frame and many share each join.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix import vocab
from engramix.functions import score, text
from engramix.operators import blocks, hashes
from engramix.storage import dealt, stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weight of a term in each indexed column.
WEIGHTS = {"chunk_text": 1.0, "source_file": 0.5, "chunk_type": 0.5}
#: Lexical hits of a query that are ranked further.
CANDIDATES = 20
RRF_K = 60
#: Wordings of a query, at most.
BATCHES = 16


#: Rows of a caller's queries (or of what is found for them) that are sent to every task; more are joined by shuffle.
FEW = 10_000
#: Scores that a task holds before it keeps each query's best.
_WAITING = 1 << 17


def if_few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def if_few_asked(df: DataFrame, queries: DataFrame, each: int) -> DataFrame:
    """df, which has at most `each` rows of a query, with a broadcast hint if the queries are few; df itself isn't computed for that."""
    return F.broadcast(df) if queries.limit(FEW // each + 1).count() <= FEW // each else df


def parsed(query: Column) -> Column:
    """The query as alternatives (OR) of factors (AND) of groups of terms: a factor's first group is wanted, each other one
    (NOT) is refused; within a group all terms. The operators are upper-case words; words beside each other are a group. Null
    if an operator lacks a side, or there is no term."""
    cut = lambda c, word: F.split(c, rf"(?<!\S){word}(?!\S)")
    groups = lambda factor: F.transform(cut(factor, "NOT"), lambda g: F.array_distinct(text.terms(g)))
    factors = lambda clause: F.transform(cut(clause, "AND"), groups)
    whole = F.transform(cut(text.sanitized_query(query), "OR"), factors)
    return F.when(~F.exists(F.flatten(F.flatten(whole)), lambda g: F.size(g) == 0), whole)


def _satisfied(expression: Column, have: Column) -> Column:
    holds = lambda group: F.forall(group, lambda t: F.array_contains(have, t))
    fits = lambda factor: holds(F.get(factor, F.lit(0))) & ~F.exists(F.slice(factor, F.lit(2), F.size(factor)), holds)
    return F.exists(expression, lambda clause: F.forall(clause, fits))


def _weighted(tokens: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("w")))


def postings(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(id, token, wtf, dl): weighted frequency of each term in each chunk, and the chunk's terms over all columns: an index to
    store, partitioned by part_of(token), where one store is searched often. by: columns to keep. Whole texts are exchanged by id, so
    that the terms, which are many times more, needn't be."""
    keep = by or []
    return _terms(dealt(chunks, "id"), keep).groupBy("id", *keep, "dl", "token").agg(F.sum("w").alias("wtf"))


def part_of(token: Column, parts: int = 256) -> Column:
    """The part of a stored index that holds a term."""
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


def length() -> Column:
    """Terms of all indexed columns of a chunk."""
    return sum((text.term_count(F.coalesce(F.col(c), F.lit(""))) for c in WEIGHTS), F.lit(0))


def _terms(chunks: DataFrame, keep: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(id, [keep], dl, token, w): every term of every indexed column, or those in the one-row frame wanted (array all); no shuffle."""
    if wanted is not None:
        chunks = chunks.crossJoin(F.broadcast(wanted))  # one row
    own = (lambda c: text.found_terms(c, F.col("all"))) if wanted is not None else text.terms
    weighted = F.concat(*(_weighted(own(F.coalesce(F.col(c), F.lit(""))), w) for c, w in WEIGHTS.items()))
    sized = chunks.select("id", *keep, length().alias("dl"), weighted.alias("ts"))
    return sized.select("id", *keep, "dl", F.explode("ts").alias("t")).select("id", *keep, "dl", "t.token", "t.w")


def corpus_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n, avgdl), for each group of `by`: one row for a store; to be stored beside an index."""
    keep = by or []
    return chunks.select(*keep, length().alias("dl")).groupBy(*keep).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _candidates(read: DataFrame, dfs: DataFrame, index: DataFrame, keep: list[str]) -> DataFrame:
    """(query_id, [keep], id) of chunks with the rarest wanted term of an alternative all of whose wanted terms occur: what many
    queries are looked up by, so that common terms don't join everything with everything."""
    ways = read.select("query_id", F.posexplode("expression").alias("way", "clause"))
    wanted = F.array_distinct(F.flatten(F.transform("clause", lambda factor: F.get(factor, F.lit(0)))))
    terms = ways.select("query_id", "way", F.size(wanted).alias("n"), F.explode(wanted).alias("token")).join(dfs, "token")
    rarest = terms.groupBy("query_id", "way", *keep).agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.count("*").alias("met"), F.first("n").alias("n")).filter("met = n")
    return rarest.select("query_id", *keep, "token").distinct().join(index.select("id", *keep, "token"), ["token", *keep]).select("query_id", *keep, "id").distinct()


def bm25(queries: DataFrame, chunks: DataFrame | None, by: list[str] | None = None, limit: int | None = CANDIDATES, index: DataFrame | None = None, stats: DataFrame | None = None, parts: int = 256) -> DataFrame:
    """(query_id, [by], id, bm25, base_rank): chunks that a query (see parsed()) matches, best first, at most `limit`. Terms that a
    query refuses only don't score.

    by: columns of chunks that name a store; each has its own statistics and its own ranking. index and stats: stored
    postings() and corpus_stats(), with which the chunks aren't read; parts: the number that part_of() was given."""
    keep = by or []
    read = queries.select("query_id", parsed(F.col("query")).alias("expression")).filter("expression is not null")
    flat = F.flatten(F.flatten("expression"))
    positive = F.flatten(F.transform(F.flatten("expression"), lambda factor: F.get(factor, F.lit(0))))
    asked = read.select("query_id", F.explode(F.array_distinct(F.flatten(flat))).alias("token"), positive.alias("ps")).select("query_id", "token", F.array_contains("ps", F.col("token")).alias("scores"))
    few = asked.limit(FEW + 1).count() <= FEW
    if not few and index is None and limit and not keep:
        return _bm25_in_blocks(read, chunks, stats, limit)
    hint = F.broadcast if few else lambda df: df
    if few and index is not None:
        part = "part" in index.columns
        wanted = asked.withColumn("part", part_of(F.col("token"), parts)) if part else asked
        held = index.join(hint(wanted), ["token", "part"] if part else "token")
    elif few:  # other terms are dropped before any shuffle
        every = asked.agg(F.collect_set("token").alias("all"))
        held = _terms(chunks, keep, every).join(hint(asked), "token").groupBy("query_id", "id", *keep, "dl", "token", "scores").agg(F.sum("w").alias("wtf"))
    if few:
        # the sums are read here too, so that both uses of `held` have one plan and its shuffle is done once
        df = held.groupBy("query_id", *keep, "token").agg(F.count("*").alias("df"), F.max("wtf").alias("top")).filter("top > 0").drop("top")
    else:
        every = postings(chunks, keep) if index is None else index.drop("part")
        own = every.join(asked.select("token").distinct(), "token", "left_semi").groupBy(*keep, "token").agg(F.count("*").alias("df"))
        found = _candidates(read, own, every, keep)
        held = found.join(asked, "query_id").join(every, ["id", *keep, "token"])
        df = asked.select("query_id", "token").join(own, "token")
    stats = corpus_stats(chunks, keep) if stats is None else stats
    rated = held.join(hint(df), ["query_id", *keep, "token"])
    rated = rated.join(stats, keep) if keep else rated.crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    gain = idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = rated.groupBy("query_id", *keep, "id").agg(F.sum(F.when(F.col("scores"), gain)).alias("bm25"), F.collect_set("token").alias("have"))
    hits = hits.join(hint(read), "query_id").filter(_satisfied(F.col("expression"), F.col("have"))).select("query_id", *keep, "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    rank = F.row_number().over(Window.partitionBy("query_id", *keep).orderBy(F.round("bm25", 9).desc(), "id"))
    ranked = hits.withColumn("base_rank", rank)
    return ranked.filter(F.col("base_rank") <= limit) if limit else ranked


def _bm25_in_blocks(read: DataFrame, chunks: DataFrame, stats: DataFrame | None, limit: int) -> DataFrame:
    """bm25() of many queries (query_id, expression): a bit for each text finds those with all wanted terms, which are scored where
    they are; neither terms nor pairs are exchanged, only the best of each task. Equal queries are asked once."""
    texts = chunks.select("id", *(text.term_text(F.coalesce(c, F.lit(""))).alias(c) for c in WEIGHTS))
    keyed = stored(read.select("query_id", F.xxhash64(F.to_json("expression")).alias("key"), "expression"), "expressions")  # an array's hash doesn't tell how it is nested
    schema = "key long, expression array<array<array<array<long>>>>"
    asked = stored(keyed.groupBy("key").agg(F.first("expression").alias("expression")).mapInArrow(_coded, schema), "coded")
    first = lambda factors: F.array_distinct(F.flatten(F.transform(factors, lambda f: F.get(f, F.lit(0)))))
    scoring = asked.select("key", F.explode(first(F.flatten("expression"))).alias("token"))
    tokens = scoring.groupBy(F.col("token").alias("key")).agg(F.array("token").alias("ws"))
    told = blocks.in_passes(tokens, texts, _counted, "token long, n long, words long")
    counts = stored(told.groupBy("token").agg(F.sum("n").alias("df"), F.sum("words").alias("words")), "counts")
    # each pass has told the words and texts of the table; without a token nothing is found
    whole = counts.filter("token is null").first()
    n, avgdl = stats.select("n", "avgdl").first() if stats is not None else (chunks.count(), whole.words / whole.df if whole and whole.df else 0.0)
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    worth = scoring.join(counts.filter("df > 0"), "token").groupBy("key").agg(F.collect_list(F.struct("token", idf.alias("idf"))).alias("ts"))
    ways = asked.select("key", F.explode("expression").alias("clause"))
    refused = F.flatten(F.transform("clause", lambda f: F.slice(f, F.lit(2), F.size(f))))
    sent = ways.select("key", first(F.col("clause")).alias("ws"), refused.alias("refused")).join(worth, "key").select("key", "ws", "refused", F.col("ts.token").alias("tokens"), F.col("ts.idf").alias("idfs"))
    met = blocks.in_passes(stored(sent, "asked"), texts, lambda b: _scored(b, avgdl, limit), "key long, id long, bm25 double", blocks.SETS // 2)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.round("bm25", 9).desc(), "id"))
    top = met.groupBy("key", "id").agg(F.max("bm25").alias("bm25")).withColumn("base_rank", rank).filter(F.col("base_rank") <= limit)
    return keyed.select("query_id", "key").join(top, "key").select("query_id", "id", "bm25", "base_rank")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), hashes.coded(batch.column(1))], ["key", "expression"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return hashes.in_lists(batches, list(WEIGHTS), hashes.TERMS)


def _counted(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of texts (id, [WEIGHTS]): texts that hold each of the words sent, and, without a word, all texts and their words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(sent.value.column("key").to_numpy())
        table, n = hashes.Known(known), np.zeros(len(known), np.int64)
        texts = words = 0
        for batch in _hashed(batches):
            lists = [batch.column(c) for c in WEIGHTS]
            of = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(x.offsets.to_numpy())) for x in lists])
            place = table.find(np.concatenate([x.values.to_numpy() for x in lists]))
            keys = np.sort(place[place >= 0] * np.int64(batch.num_rows) + of[place >= 0])
            n += np.bincount(keys[np.diff(keys, prepend=-1) != 0] // batch.num_rows, minlength=len(known))
            texts, words = texts + batch.num_rows, words + len(of)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([None, *known[met].tolist()], pa.int64()), pa.array(np.append(texts, n[met])), pa.array(np.append(words, np.zeros(len(met), np.int64)))], ["token", "n", "words"])

    return search


def _scored(sent: Broadcast, avgdl: float, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of texts (id, [WEIGHTS]): the `limit` best of those that hold all wanted terms of a way to satisfy a query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value.column("key").to_numpy()
        wanted, refused, tokens, idfs = (sent.value.column(c).combine_chunks() for c in ("ws", "refused", "tokens", "idfs"))
        groups = refused.flatten()
        known = np.unique(np.concatenate([wanted.flatten().to_numpy(), groups.flatten().to_numpy(), tokens.flatten().to_numpy()]))
        place, start, idf = np.searchsorted(known, tokens.flatten().to_numpy()), tokens.offsets.to_numpy(), idfs.flatten().to_numpy()
        start = start - start[0]
        sets = blocks.by_width(known, wanted)
        refusals = {i: [np.searchsorted(known, g) for g in refused[i].as_py()] for i in np.flatnonzero(np.diff(refused.offsets.to_numpy()))}
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        least = np.full(len(keys), -np.inf)  # scores that `limit` texts have reached; equal ones go by their ids
        waiting = 0

        def cut() -> None:
            i, ids, score = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((ids, -np.round(score, 9), i))
            i, ids, score = blocks.first_of(i[order], limit, i[order], ids[order], score[order])
            best[:] = [(i, ids, score)]
            full = np.flatnonzero(np.bincount(i, minlength=len(keys)) >= limit)
            least[full] = np.round(score[np.searchsorted(i, full, "right") - 1], 9)

        for block, lengths in blocks.blocks(known, _hashed(batches), WEIGHTS):
            norm = K1 * (1 - B + B * lengths / avgdl)
            for of, rows in sets:
                for i, texts in blocks.holding(block, of, rows, refusals):
                    for lo in range(0, len(i), 1 << 17):
                        q, d = i[lo : lo + (1 << 17)], texts[lo : lo + (1 << 17)]
                        n = start[q + 1] - start[q]
                        pair = np.repeat(np.arange(len(q)), n)
                        term = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[q], n)
                        at, held = block.find(place[term], d[pair])
                        wtf = np.where(held, block.weights[at], 0.0)
                        gain = idf[term] * wtf * (K1 + 1) / (wtf + norm[d[pair]])
                        score = np.bincount(pair, gain, len(q))
                        good = np.round(score, 9) >= least[q]
                        best.append((q[good], block.ids[d[good]], score[good]))
                        waiting += len(best[-1][0])
                        if waiting > max(_WAITING, len(best[0][0])):  # so that all cuts together sort each row a few times
                            cut()
                            waiting = 0
        cut()
        i, ids, score = best[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(ids), pa.array(score)], ["key", "id", "bm25"])

    return search


def boosts(as_of: Column, kind: float, recent: float, entities: Column, tiers: bool = False, salience: bool = False) -> Column:
    """The sum of all deltas; factors are never multiplied."""
    c = {k: F.col(k) for k in ("last_accessed_at", "source_date", "created_at", "retention_days", "chunk_type", "importance", "pain", "access_count")}
    total = score.type_delta(F.col("chunk_type"), kind) + score.recency_delta(as_of, F.col("source_date"), recent) + score.source_delta(F.col("source_type"), F.col("section"), entities) + score.section_delta(F.col("section"), F.col("section_boost"))
    if tiers:
        total = total + score.tier_delta(F.col("tier"))
    if salience:
        total = total + score.salience(as_of, c) - 0.5
    return total


def lexical(queries: DataFrame, chunks: DataFrame, as_of: Column, limit: int = 5, entities: Column | None = None, index: DataFrame | None = None, stats: DataFrame | None = None, parts: int = 256, **options: bool) -> DataFrame:
    """Boosted lexical results: (query_id, id, score, rank) and the chunks' columns. index, stats, parts: see bm25()."""
    hits = if_few_asked(bm25(queries, chunks, index=index, stats=stats, parts=parts), queries, CANDIDATES).join(chunks, "id")
    scored = hits.withColumn("score", score.round2(F.abs("bm25") * (1 + boosts(as_of, 1.0, 0.5, entities or F.lit(0), **options))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_rank"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, base_rank) of the k nearest vectors (id, embedding) of each query (query_id, vector).

    A few stated queries are sent to the vectors; more go there in passes. Each task keeps k of each before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    if queries.limit(STATED + 1).count() <= STATED:
        pairs = vectors.join(F.broadcast(queries), F.size("vector") == F.size("embedding"))
        far = pairs.select("query_id", "id", l2(F.col("vector"), F.col("embedding")).alias("distance"))
    else:
        far = _in_passes(queries, vectors, k, False).select("query_id", "id", F.sqrt("far").alias("distance"))
    return far.withColumn("base_rank", rank).filter(F.col("base_rank") <= k)


def semantic(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, as_of: Column, limit: int = 5, entities: Column | None = None, **options: bool) -> DataFrame:
    """Boosted vector results: twice `limit` neighbours, base (1 - d / max d) * 10, cut to limit."""
    hits = if_few_asked(nearest(queries, vectors, 2 * limit), queries, 2 * limit)
    widest = F.max("distance").over(Window.partitionBy("query_id"))
    based = hits.withColumn("base", F.when(widest == 0, 10.0).otherwise((1 - F.col("distance") / F.when(widest > 0, widest)) * 10)).join(chunks, "id")
    scored = based.withColumn("score", score.round2(F.col("base") * (1 + boosts(as_of, 0.5, 0.2, entities or F.lit(0), **options))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_rank"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def fuse(batches: DataFrame, keep: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, batch_no, kind, rank, id, source_file, chunk_text): one row for each file and text start.

    match_type is fts, semantic or hybrid. Ties keep the order of first appearance."""
    key = ["query_id", "source_file", F.substring("chunk_text", 1, 50).alias("start")]
    first = F.min_by("id", F.struct("batch_no", "rank")).alias("id")
    seen = F.min(F.struct("batch_no", "rank")).alias("seen")
    merged = batches.groupBy(*key).agg(first, seen, F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.collect_set("kind").alias("kinds"))
    kind = F.when(F.size("kinds") > 1, "hybrid").otherwise(F.element_at("kinds", 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "seen"))
    ranked = merged.withColumn("rank", rank).filter(F.col("rank") <= keep)
    return ranked.select("query_id", "id", "source_file", (score.round2(F.col("rrf") * 1000)).alias("score"), kind.alias("match_type"), "rank")


def hybrid(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, chunks: DataFrame, as_of: Column, limit: int = 5, dedupe: bool = True, variants: DataFrame | None = None, **index: DataFrame | int) -> DataFrame:
    """Lexical and semantic results fused, then thinned by the four rules of thin().

    variants: expanded() queries (query_id, batch_no below BATCHES, query), a lexical batch each instead of the queries' own;
    all batches are searched at once. index: see bm25()."""
    one = lambda df, no, kind: df.select("query_id", no.alias("batch_no"), F.lit(kind).alias("kind"), "rank", "id", "source_file", "chunk_text")
    worded = queries.select("query_id", F.lit(0).alias("batch_no"), "query") if variants is None else variants
    found = lexical(worded.select((F.col("query_id") * BATCHES + F.col("batch_no")).alias("query_id"), "query"), chunks, as_of, 2 * limit, **index)
    batch = F.pmod("query_id", F.lit(BATCHES)).cast("int")
    fts = one(found, batch, "fts").withColumn("query_id", F.floor(F.col("query_id") / BATCHES))
    batches = fts.unionByName(one(semantic(query_vectors, vectors, chunks, as_of, 4 * limit), F.lit(BATCHES), "semantic"))
    most = max(3 * limit, 15)
    fused = fuse(batches, most)
    if not dedupe:
        return fused
    rows = if_few_asked(fused.drop("source_file"), queries, most).join(chunks.select("id", "source_file", "chunk_text", "chunk_type", "section"), "id")
    return thin(rows, limit)


def cap_by_file(rows: DataFrame, cap: int, order: str = "rank") -> DataFrame:
    """At most `cap` rows of a file in each query, the first ones."""
    n = F.row_number().over(Window.partitionBy("query_id", "source_file").orderBy(order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= cap).drop("_n")


def cap_by_type(rows: DataFrame, limit: int) -> DataFrame:
    """At most ceil(0.6 limit) rows of a type come first; the others follow, as far as the limit has room."""
    n = F.row_number().over(Window.partitionBy("query_id", "chunk_type").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_n") > -(-6 * limit // 10), "rank"))
    return rows.withColumn("_n", n).withColumn("place", place).filter(F.col("place") <= limit).drop("_n")


def _pick(frame: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The rules of thin() for one query's rows; each looks at what the ones before have kept."""
    frame = frame.sort_values("rank", kind="stable")
    frame = frame[frame.groupby("source_file").cumcount() < 3]
    kept, sets = [], []
    for i, words in zip(frame.index, frame["chunk_text"].fillna("").str[:180].str.lower().str.split(), strict=True):
        own = {tuple(words[j : j + 3]) for j in range(len(words) - 2)} or {tuple(words)}
        if all(len(own & s) < 0.85 * len(own | s) for s in sets):
            kept.append(i)
            sets.append(own)
    frame = frame.loc[kept]
    benched = frame.groupby("chunk_type").cumcount() >= -(-6 * limit // 10)
    frame = pd.concat([frame[~benched], frame[benched]]) if (~benched).sum() < limit else frame[~benched]
    out, files = [], {}
    for i, file, section in zip(frame.index, frame["source_file"], frame["section"], strict=True):
        if files.get(file, 0) < (2 if section is None or section != section else 3):
            files[file] = files.get(file, 0) + 1
            out.append(i)
        if len(out) == limit:
            break
    return frame.loc[out]


def thin(rows: DataFrame, limit: int) -> DataFrame:
    """Of each query's ranked rows (at most a few dozen): three of a file; none like an earlier one (Jaccard 0.85 of word
    triples); a type's surplus last; then two of a file, three in a section; `limit` in all. Greedy, so a grouped map."""
    kept = rows.select("query_id", "id", "source_file", "chunk_text", "chunk_type", "section", "score", "match_type", "rank")
    return kept.groupBy("query_id").applyInPandas(lambda frame: _pick(frame, limit), kept.schema)


def across_stores(queries: DataFrame, chunks: DataFrame, store: str, limit: int = 5, **index: DataFrame | int) -> DataFrame:
    """Each store's best hits by its own statistics, merged; of equal text starts the best stays. index: see bm25()."""
    hits = if_few(bm25(queries, chunks, [store], limit, **index)).join(chunks.drop(store), "id").withColumn("score", F.round("bm25", 6))
    same = F.row_number().over(Window.partitionBy("query_id", F.substring("chunk_text", 1, 100)).orderBy(F.desc("score"), store, "id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), store, "id"))
    return hits.withColumn("_same", same).filter("_same = 1").withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", store, "id", "score", "rank")


def entity_count(queries: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, entities): names found in each query, longest first, each match blanked before the next is sought.

    Without names, runs of capitalised words and quoted strings count. The names are a dictionary of the caller's."""
    ordered = sorted({n.strip().lower() for n in names if n and n.strip()}, key=lambda n: (-len(n), n))
    if not ordered:
        found = F.array_distinct(F.regexp_extract_all("query", F.lit(r"(\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\"[^\"]+\")"), F.lit(1)))
        return queries.select("query_id", F.size(found).alias("entities"))

    known = F.from_json(F.lit(json.dumps(ordered)), "array<string>")
    start = F.struct(F.lower(F.coalesce("query", F.lit(""))).alias("rest"), F.lit(0).alias("n"))
    blanked = lambda s, name: F.struct(F.replace(s["rest"], name, F.repeat(F.lit(" "), F.length(name))).alias("rest"), (s["n"] + 1).alias("n"))
    found = F.aggregate(known, start, lambda s, name: F.when(F.contains(s["rest"], name), blanked(s, name)).otherwise(s), lambda s: s["n"])
    return queries.select("query_id", found.alias("entities"))


def temporal_rerank(rows: DataFrame, queries: DataFrame, as_of: Column, sigma: float = 30.0) -> DataFrame:
    """Re-rank each query's top 20 (query_id, rank, score, day) by nearness to the date that the query is about.

    Without a date in the query, the upper median of the top five's days stands in (two days at least)."""
    intent = queries.select("query_id", text.temporal_intent(F.col("query"), as_of).alias("i")).select("query_id", "i.source", "i.anchor")
    top = rows.filter("rank <= 20").join(if_few(intent), "query_id")
    within = Window.partitionBy("query_id")
    days = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("rank") <= 5, F.col("day"))).over(within)))
    middle = F.when(F.size(days) >= 2, F.get(days, F.floor(F.size(days) / 2).cast("int")))
    best = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(within)
    anchor = F.coalesce("anchor", F.when(F.col("source").isNotNull(), middle))
    trust = F.when(F.col("source") == "iso_date", 1.0).when(F.col("source") == "month_year", 0.8).when(F.col("source") == "year", 0.5).when(anchor.isNotNull(), 0.3)
    near = 0.5 * F.exp(-F.pow(F.datediff(F.col("day"), anchor).cast("double"), 2.0) / (2 * sigma * sigma))
    bump = F.when((F.col("rank") == 1) | near.isNull(), 0.0).otherwise(F.least(2 * near, F.lit(1.0)) * F.greatest(best - F.col("score"), F.lit(0.1)) * trust)
    moved = top.withColumn("new_score", F.round(F.col("score") + bump, 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank"))
    return moved.withColumn("new_rank", place)


def expanded(queries: DataFrame, expand: Callable[[str], list[str]], variants: int = 2) -> DataFrame:
    """(query_id, batch_no, query): each query and up to `variants` rewordings by an outside model; none for queries of fewer than
    three words, or where the model fails. Queries are few and the caller's, so the model is asked on the driver."""
    out = []
    for r in queries.select("query_id", "query").collect():
        said: list[str] = []
        if len((r.query or "").split()) >= 3:
            try:
                said = [v.strip() for v in expand(r.query) if v and v.strip() and v.strip() != r.query]
            except Exception:  # an outside service
                said = []
        out += [(r.query_id, i, q) for i, q in enumerate([r.query, *said[:variants]])]
    return queries.sparkSession.createDataFrame(out, "query_id long, batch_no int, query string")


def search_log(queries: DataFrame, results: DataFrame, as_of: Column, latency_ms: float, semantic: bool) -> DataFrame:
    """Telemetry rows of answered queries: hash, words, results."""
    n = results.groupBy("query_id").agg(F.count("*").alias("results_count"))
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    out = queries.join(n, "query_id", "left")
    return out.select(as_of.alias("ts"), text.query_hash(F.col("query")).alias("query_hash"), words.alias("query_words"), F.coalesce("results_count", F.lit(0)).cast("int").alias("results_count"), F.lit(semantic).alias("has_semantic"), F.lit(latency_ms).alias("latency_ms"))


def churn_report(found: DataFrame) -> DataFrame:
    """(new_file, old_file, exact, n, first_new_id) of churn() rows."""
    return found.groupBy("new_file", "old_file", "exact").agg(F.count("*").alias("n"), F.min("new_id").alias("first_new_id"))


def rerank(rows: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k_in: int = 50, k_out: int = 10) -> DataFrame:
    """The best k_out of each query's first k_in rows (query_id, query, id, chunk_text, rank) by an external scorer.

    If the scorer fails for a batch, that batch keeps its order."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                value = [float(x) for x in scorer(frame["query"].tolist(), frame["chunk_text"].tolist())]
            except Exception:  # an outside service
                value = (-frame["rank"]).astype(float).tolist()
            yield frame[["query_id", "id", "rank"]].assign(rerank_score=value)

    scored = rows.filter(F.col("rank") <= k_in).select("query_id", "query", "id", "chunk_text", "rank").mapInPandas(judge, "query_id long, id long, rank int, rerank_score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return scored.withColumn("new_rank", place).filter(F.col("new_rank") <= k_out)


def rank_changes(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, position_changes, mean_shift) between two rankings (query_id, id, rank): ids at another place count, and
    the mean distance they moved over k, where an id in one ranking only moved by k."""
    a, b = before.select("query_id", "id", F.col("rank").alias("ra")), after.select("query_id", "id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    shift = F.coalesce(F.abs(F.col("ra") - F.col("rb")), F.lit(k))
    return both.groupBy("query_id").agg(F.count_if(~F.col("ra").eqNullSafe(F.col("rb"))).alias("position_changes"), F.round(F.sum(shift) / (F.count("*") * k), 6).alias("mean_shift"))


#: Stated queries that are compared by column expressions, and bytes of query vectors that are sent to all tasks in a pass beyond.
STATED, PASS_BYTES = 64, 16 << 20


def _nearest_here(asked, k: int, rounded: bool):
    """Over frames of vectors: the k nearest of each broadcast query among them all, its own id aside if `rounded`."""

    def order(far: np.ndarray) -> np.ndarray:
        return -np.round(1 - far / 2, 9) if rounded else far

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            sizes = frame["embedding"].map(len).to_numpy()
            for size, (qids, x) in asked.value.items():
                near = frame[sizes == size]
                if not size or near.empty:
                    continue
                y, ids = np.stack(near["embedding"].to_list()).astype(np.float64), near["id"].to_numpy()
                at = (y * y).sum(1)
                for lo in range(0, len(qids), 256):
                    rough = at - 2 * (x[lo : lo + 256] @ y.T) + (x[lo : lo + 256] ** 2).sum(1)[:, None]
                    for n, row in enumerate(rough, lo):
                        # products find what may be among the first, differences rank it
                        own = ids == qids[n] if rounded else np.zeros(len(ids), bool)
                        row[own] = np.inf
                        held, far = best.get((size, n), (np.zeros(0, np.int64), np.zeros(0)))
                        most = far[-1] if len(held) == k else np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1] if len(row) >= k else np.inf
                        i = np.flatnonzero((row <= most + 1e-7 * (1 + at + (x[n] ** 2).sum())) & ~own)
                        if len(i):
                            held, far = np.concatenate([held, ids[i]]), np.concatenate([far, ((y[i] - x[n]) ** 2).sum(1)])
                            first = np.lexsort((held, order(far)))[:k]
                            best[size, n] = held[first], far[first]
        for (size, n), (held, far) in best.items():
            yield pd.DataFrame({"query_id": np.full(len(held), asked.value[size][0][n]), "id": held, "far": far})

    return search


def _in_passes(queries: DataFrame, vectors: DataFrame, k: int, rounded: bool) -> DataFrame:
    """(query_id, id, far): squared distances of each query's k nearest vectors in each task. Vectors stay where they are; the
    queries are sent to them PASS_BYTES at a time."""
    q, v = queries.filter("vector is not null").select("query_id", "vector"), vectors.filter("embedding is not null").select("id", "embedding")
    spark = q.sparkSession
    components = q.agg(F.sum(F.size("vector"))).first()[0] or 0
    passes = max(1, -(-8 * components // PASS_BYTES))
    out = None
    for turn in range(passes):
        rows = q.filter(F.pmod(F.xxhash64("query_id", "vector"), F.lit(passes)) == turn).collect() if passes > 1 else q.collect()  # about PASS_BYTES
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r.vector), []).append(r)
        asked = spark.sparkContext.broadcast({n: (np.array([r.query_id for r in rs], np.int64), np.array([r.vector for r in rs], np.float64).reshape(len(rs), n)) for n, rs in by.items()})
        part = v.mapInPandas(_nearest_here(asked, k, rounded), "query_id long, id long, far double")
        out = part if out is None else out.unionByName(part)
    return out


def most_similar(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, r): the k vectors (id, embedding) most similar (1 - d^2 / 2, to nine digits; then the smaller id)
    to each query (query_id, vector), itself aside, among all of its size. Exact, however many there are of either."""
    met = _in_passes(queries, vectors, k, True).withColumn("similarity", 1 - F.col("far") / 2).drop("far")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id"))
    return met.withColumn("r", rank).filter(F.col("r") <= k)


def churn(chunks: DataFrame, vectors: DataFrame, since: Column, k: int = 5, least: float = 0.8, kind: str | None = None) -> DataFrame:
    """For each chunk created after `since` its nearest older neighbour among the k + 1 nearest of all, if similar enough:
    (new_id, old_id, new_file, old_file, similarity, exact). Similarity is 1 - d^2 / 2 of unit vectors."""
    own = chunks if kind is None else chunks.filter(F.col("chunk_type") == kind)
    fresh = vectors.join(own.filter(F.col("created_at") >= since).select("id"), "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    top = most_similar(fresh, vectors.join(own.select("id"), "id", "left_semi"), k + 1)
    older = top.join(own.select("id", "created_at", "source_file"), "id").filter((F.col("created_at") < since) & (F.col("similarity") >= least))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("r"))
    best = older.withColumn("f", first).filter("f = 1")
    named = best.join(chunks.select(F.col("id").alias("query_id"), F.col("source_file").alias("new_file")), "query_id")
    return named.select(F.col("query_id").alias("new_id"), F.col("id").alias("old_id"), "new_file", F.col("source_file").alias("old_file"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.995).alias("exact"))
