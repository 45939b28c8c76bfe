"""Grounded answers: retrieved context, prompts within a budget, checked citations, cached reflections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import score, text
from engramix.storage import dealt

EMPTY = "No relevant memories were found for this question."


class Completer(Protocol):
    """An outside language model."""

    def __call__(self, prompt: str) -> str: ...


def context(hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, marker, id, content, score): the best 2 k hits (query_id, id, content, score, content_hash), one for each hash (or id
    without a hash), cut to k and marked chunk_1, chunk_2, ..."""
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    many = hits.withColumn("p", F.row_number().over(over)).filter(F.col("p") <= 2 * k)
    same = F.coalesce("content_hash", F.concat(F.lit("id:"), F.col("id").cast("string")))
    once = many.withColumn("d", F.row_number().over(Window.partitionBy("query_id", same).orderBy("p"))).filter("d = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("p"))
    return once.withColumn("place", place).filter(F.col("place") <= k).select("query_id", F.concat(F.lit("chunk_"), F.col("place")).alias("marker"), "id", "content", "score", "place")


def prompts(rows: DataFrame, max_tokens: int = 4000, reserved: int = 800) -> DataFrame:
    """(query_id, chunks, prompt): the best rows of context() that fit (max_tokens - reserved) * 4 characters, one at least."""
    run = F.sum(F.length("content")).over(Window.partitionBy("query_id").orderBy("place"))
    kept = rows.withColumn("upto", run).filter((F.col("place") == 1) | (F.col("upto") <= (max_tokens - reserved) * 4))
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), F.col("marker"), F.lit("] "), F.col("content")).alias("t"))))
    return kept.groupBy("query_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n").alias("prompt"))


def citations(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, marker, id, valid) for each distinct [chunk_n] in an answer (query_id, answer)."""
    cited = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(chunk_\d+)\]"), F.lit(1)))).alias("marker"))
    return cited.join(rows.select("query_id", "marker", "id"), ["query_id", "marker"], "left").withColumn("valid", F.col("id").isNotNull())


def answer(question: str, hits: DataFrame, complete: Completer, k: int = 5, retries: int = 1) -> dict[str, object]:
    """One question (its hits have any query_id). Nothing found: a fixed text, and the model isn't asked. An answer that cites
    what it wasn't given is asked for again, then refused."""
    found = context(hits, k).orderBy("place").collect()  # k rows
    if not found:
        return {"answer": EMPTY, "citations": [], "ok": True}
    known = {r.marker: r.id for r in found}
    body = prompts(context(hits, k)).first().prompt
    import re

    for _ in range(retries + 1):
        said = complete(f"{body}\n\nQuestion: {question}")
        cited = list(dict.fromkeys(re.findall(r"\[(chunk_\d+)\]", said)))
        if all(c in known for c in cited):
            return {"answer": said, "citations": [known[c] for c in cited], "ok": True}
    return {"answer": "", "citations": [], "ok": False, "failed_reason": "hallucinated_citation"}


def _most_similar(entries: list[tuple[str | None, list[float]]], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over frames of questions (query_id, embedding): the entry (response, vector) of the greatest cosine to nine digits, of equals the one
    with the greatest response (none comes last), where it is `least` or more. Unlike sizes don't meet; a vector of zeros is like none; a
    cosine that is no number is above all, as in Spark's order."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[int, list[int]] = {}
        for i in sorted(range(len(entries)), key=lambda i: (entries[i][0] is not None, (entries[i][0] or "").encode()), reverse=True):
            by.setdefault(len(entries[i][1]), []).append(i)
        held = {n: (np.array(own), np.array([entries[i][1] for i in own], float).reshape(len(own), n)) for n, own in by.items()}
        norm = lambda a: np.sqrt((a * a).sum(1))
        for frame in frames:
            sizes = frame["embedding"].map(len).to_numpy()
            for n, (own, y) in held.items():
                for few in np.array_split(np.flatnonzero(sizes == n), max(1, len(frame) // 2000)):
                    if not len(few):
                        continue
                    x = np.stack(frame["embedding"].iloc[few].to_list()).astype(float).reshape(len(few), n)
                    with np.errstate(all="ignore"):
                        both = norm(x)[:, None] * norm(y)
                        s = np.where(both == 0, 0.0, np.round(x @ y.T / both, 9))
                    rank = np.where(np.isnan(s), np.inf, s)
                    best = rank.argmax(1)  # the first of equals
                    good = np.flatnonzero(rank.max(1) >= least)
                    yield pd.DataFrame({"query_id": frame["query_id"].iloc[few[good]].to_numpy(), "entry": own[best[good]].astype(np.int32), "s": rank[good, best[good]]})

    return search


def cached(questions: DataFrame, cache: DataFrame, as_of: Column, least: float = 0.88, newest: int = 500) -> DataFrame:
    """(query_id, hit, response, sources) of questions (query_id, query_hash, embedding) from a cache (query_hash, response,
    evidence_sources, created_at, ttl_hours, cached_embedding): equal hash, else the most similar (to nine digits) of the
    newest live entries if similar enough."""
    live = cache.filter(score.days_between(as_of, F.col("created_at")) * 24 <= F.col("ttl_hours")).withColumn("sources", F.coalesce("evidence_sources", F.lit("[]")) if "evidence_sources" in cache.columns else F.lit("[]"))
    exact = questions.join(live.select("query_hash", "response", "sources"), "query_hash").select("query_id", F.lit("exact").alias("hit"), "response", "sources", F.lit(2.0).alias("s"))
    new = live.filter("cached_embedding is not null").orderBy(F.desc("created_at"), "query_hash").limit(newest)  # bounded, so it may be broadcast
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    entries = new.filter(whole("cached_embedding")).select("response", "sources", F.col("cached_embedding").cast("array<double>").alias("v")).collect()  # `newest` rows
    asked = dealt(questions.filter(whole("embedding")).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
    kinds = f"query_id {dict(questions.dtypes)['query_id']}, entry int, s double"
    best_of = asked.mapInPandas(_most_similar([(r.response, r.v) for r in entries], least), kinds)
    said = questions.sparkSession.createDataFrame([(i, r.response, r.sources) for i, r in enumerate(entries)], "entry int, response string, sources string")
    similar = best_of.join(F.broadcast(said), "entry").select("query_id", F.lit("semantic").alias("hit"), "response", "sources", "s")
    best = exact.unionByName(similar).groupBy("query_id").agg(F.max_by(F.struct("hit", "response", "sources"), F.struct("s", "response")).alias("b"))
    return best.select("query_id", "b.hit", "b.response", "b.sources")


class Evidence(NamedTuple):
    """What an answer by reflection rests on."""

    chunks: list[tuple[str, str, float]]  # text, source, score
    entities: list[tuple[str, str, list[str]]]  # name, type, "relation -> target"
    decisions: list[tuple[str, str]]  # key, content
    paths: list[str]

    def text(self, most: int = 2000) -> str:
        parts = ["MEMORY CHUNKS:", *(f"- [score:{s:.2f}] {t[:300]}" for t, _, s in self.chunks[:5])] if self.chunks else []
        if self.entities:
            parts += ["\nKG ENTITIES:", *(f"- {n} ({k}) rels: {', '.join(rs[:5]) or 'none'}" for n, k, rs in self.entities[:5])]
        if self.decisions:
            parts += ["\nDECISIONS:", *(f"- [{k}] {c[:200]}" for k, c in self.decisions[:3])]
        if self.paths:
            parts += ["\nGRAPH PATHS:", *(f"- {p}" for p in self.paths)]
        whole = "\n".join(parts)
        return whole if len(whole) <= most else whole[:most] + "\n[truncated]"


def names_in(question: str, most: int = 5) -> list[str]:
    """Capitalised words of three letters or more, each once: entities that a question may mean."""
    found = dict.fromkeys("".join(c for c in w if c.isalpha() or c == "-") for w in question.split() if len(w) > 2 and w[0] == w[0].upper())
    return [n for n in found if n][:most]


def related_decisions(question: str, decisions: DataFrame, most: int = 3) -> DataFrame:
    """(key, content) of the current decisions that hold a word of four letters or more of the question."""
    words = F.array(*(F.lit(w.lower()) for w in question.split() if len(w) > 3)).cast("array<string>")
    said = F.lower(F.concat_ws("\n", "key", "content"))
    return decisions.filter("is_current").filter(F.exists(words, lambda w: F.contains(said, w))).orderBy("key").limit(most).select("key", "content")


def reflect(question: str, cache: DataFrame, gather: Callable[[str], Evidence], complete: Completer, as_of: Column, vector: list[float] | None = None, use_cache: bool = True) -> dict[str, object]:
    """An answer from the cache (equal question, else a similar one if `vector` is given), else by an outside model from evidence.

    `entry` is the row that remembered() adds to the cache; None for answers that come from it."""
    spark = cache.sparkSession
    asked = spark.createDataFrame([(0, question, [float(x) for x in vector or []])], "query_id long, query string, embedding array<double>").withColumn("query_hash", text.rolling_hash(F.col("query")))
    found = cached(asked, cache, as_of).first() if use_cache else None
    if found is not None:
        return {"answer": found.response, "evidence_count": 0, "cached": found.hit, "sources": json.loads(found.sources), "entry": None}
    evidence = gather(question)
    sources = [source for _, source, _ in evidence.chunks[:5]]
    try:
        said = complete(f"Answer from the evidence, in the question's language; cite sources; say so if it isn't enough.\n\nQUESTION: {question}\n\nEVIDENCE:\n{evidence.text()}").strip() or "[reflect: empty response]"
    except Exception as e:  # an outside service
        said = f"[reflect error: {str(e)[:150]}]"
    entry = (question, said, json.dumps(sources), [float(x) for x in vector] if vector else None)
    return {"answer": said, "evidence_count": len(evidence.chunks) + len(evidence.entities) + len(evidence.decisions), "cached": None, "sources": sources, "entry": entry}


def remembered(cache: DataFrame, entry: tuple[str, str, str, list[float] | None], model: str, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """The cache with the entry; an older one of an equal question goes."""
    row = cache.sparkSession.createDataFrame([entry], "query string, response string, evidence_sources string, cached_embedding array<float>")
    row = row.withColumns({"query_hash": text.rolling_hash(F.col("query")), "model": F.lit(model), "created_at": as_of, "ttl_hours": F.lit(ttl_hours)})
    return cache.join(F.broadcast(row.select("query_hash")), "query_hash", "left_anti").unionByName(row.select(*cache.columns))  # one row


class Chain:
    """Providers asked in turn; one that fails, or is slower than the timeout (seconds), is skipped for the cooldown. A refused
    key (PermissionError) ends the chain."""

    def __init__(self, providers: list[tuple[str, Completer]], clock: Callable[[], float], cooldown: float = 60.0, timeout: float = 30.0) -> None:
        self.providers, self.clock, self.cooldown, self.timeout = providers, clock, cooldown, timeout
        self.resting: dict[str, float] = {}

    def _asked(self, provider: Completer, prompt: str) -> str:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(provider, prompt).result(self.timeout)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def __call__(self, prompt: str) -> str:
        failures = []
        for name, provider in self.providers:
            if self.resting.get(name, float("-inf")) > self.clock():
                failures.append(f"{name}: cooling down")
                continue
            try:
                return self._asked(provider, prompt)
            except PermissionError:
                raise
            except Exception as e:  # an outside service
                self.resting[name] = self.clock() + self.cooldown
                failures.append(f"{name}: {e}")
        raise RuntimeError("; ".join(failures) or "no provider")


def spent(calls: DataFrame, as_of: Column, cap_usd: float, hours: int = 24) -> DataFrame:
    """(usd, over) of the calls (ts, cost_usd) of the last hours; over: they cost the cap or more."""
    recent = (score.days_between(as_of, F.col("ts")) * 24).between(0, hours)
    return calls.agg(F.round(F.coalesce(F.sum(F.when(recent, F.col("cost_usd"))), F.lit(0.0)), 9).alias("usd")).withColumn("over", F.col("usd") >= cap_usd)


def over_cap(calls: DataFrame, as_of: Column, cap_usd: float, hours: int = 24) -> bool:
    """Whether the calls (ts, cost_usd) of the last hours cost the cap or more."""
    return spent(calls, as_of, cap_usd, hours).first().over


def cache_stats(cache: DataFrame, top: int = 5) -> DataFrame:
    """(place, query_hash, hits, entries, total_hits): the most used entries of a cache (query_hash, hit_count)."""
    total = cache.agg(F.count("*").alias("entries"), F.sum("hit_count").alias("total_hits"))
    best = cache.orderBy(F.desc("hit_count"), "query_hash").limit(top)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("hit_count"), "query_hash"))  # top rows
    return best.select(place.alias("place"), "query_hash", F.col("hit_count").alias("hits")).crossJoin(F.broadcast(total))  # one row
