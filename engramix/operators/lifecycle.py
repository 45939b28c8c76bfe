"""The life of memories: salience classes, tiers, retention, compaction, merging of re-read files, sharing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix import vocab
from engramix.functions import score, text
from engramix.operators import blocks, hashes, search
from engramix.storage import stored


def _columns() -> dict[str, Column]:
    return {k: F.col(k) for k in ("last_accessed_at", "source_date", "created_at", "retention_days", "chunk_type", "importance", "pain", "access_count")}


def with_salience(chunks: DataFrame, as_of: Column) -> DataFrame:
    s = score.salience(as_of, _columns())
    old = score.salience_product(as_of, _columns())
    return chunks.withColumns({"salience": s, "salience_product": old, "salience_class": score.salience_class(old)})


def distribution(chunks: DataFrame, as_of: Column, value: str = "salience_product") -> DataFrame:
    """One row: rows in each salience class, the mean, and the upper median (element floor(n / 2) of the sorted values)."""
    scored = with_salience(chunks, as_of)
    counts = scored.agg(*(F.count_if(F.col("salience_class") == c).alias(c) for c in ("promote", "retain", "review", "archive")), F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))
    # the element itself, from counts of equal rounded values, so that no task sorts all rows
    values = scored.groupBy(F.round(value, 6).alias("v")).agg(F.count("*").alias("c"))
    return counts.crossJoin(kth(values, F.floor(F.col("total") / 2) + 1).withColumnRenamed("v", "median"))  # one row each


def kth(values: DataFrame, place: Column, by: list[str] | None = None) -> DataFrame:
    """([by], v) of the element at `place` (from 1; may use `total`) of the multiset (v, c), for each group of `by`.

    Each group's values are cut into 256 ranges of equal width; the ranges are summed, and a range is sorted on its own, so no
    task sorts a whole group."""
    keep = by or []
    total = values.groupBy(*keep).agg(F.sum("c").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = values.join(total, keep) if keep else values.crossJoin(F.broadcast(total))  # one row
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    placed = placed.withColumn("part", F.coalesce(F.floor((F.col("v") - F.col("lo")) / width * 255).cast("int"), F.lit(0)))
    sums = placed.groupBy(*keep, "part").agg(F.sum("c").alias("pc"))
    earlier = Window.partitionBy(*keep, F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a group
    before = sums.withColumn("before", F.coalesce(F.sum("pc").over(earlier), F.lit(0))).drop("pc")
    within = placed.join(before, [*keep, "part"])
    run = F.sum("c").over(Window.partitionBy(*keep, "part").orderBy("v"))
    hit = within.withColumn("upto", F.col("before") + run).filter((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place))
    return hit.select(*keep, "v")


def retier(chunks: DataFrame, as_of: Column) -> DataFrame:
    """tier_after and retention_after. The rules run in order, so a chunk may rise twice: often read peripherals, then
    very often read ones (kept for ever), then fall idle ones, then little read core ones."""
    n = F.coalesce("access_count", F.lit(0))
    first = F.when((F.col("tier") == "peripheral") & (n >= 3), "working").otherwise(F.col("tier"))
    out = chunks.withColumn("_1", first)
    rises = (F.col("_1") == "working") & (n >= 10)
    out = out.withColumn("_2", F.when(rises, "core").otherwise(F.col("_1"))).withColumn("retention_after", F.when(~rises | rises.isNull(), F.col("retention_days")))
    idle = (F.col("_2") == "working") & (n == 0) & (score.days_between(as_of, F.col("created_at")) > 30)
    out = out.withColumn("_3", F.when(idle, "peripheral").otherwise(F.col("_2")))
    cold = (F.col("_3") == "core") & (n < 5) & (F.col("last_accessed_at").isNull() | (score.days_between(as_of, F.col("last_accessed_at")) > 60))
    return out.withColumn("tier_after", F.when(cold, "working").otherwise(F.col("_3"))).drop("_1", "_2", "_3")


def archive_candidates(chunks: DataFrame, as_of: Column) -> DataFrame:
    """Chunks outside the core that are older than their retention and never read."""
    days = F.coalesce(F.col("retention_days"), score.lookup(F.col("chunk_type"), vocab.RETENTION_DAYS, vocab.RETENTION_FALLBACK))
    return chunks.filter((F.col("tier") != "core") & (F.coalesce("access_count", F.lit(0)) == 0) & (score.days_between(as_of, F.col("created_at")) > days))


def retention_buckets(chunks: DataFrame) -> DataFrame:
    d = F.col("retention_days")
    return chunks.agg(F.count_if(d.isNull()).alias("never"), F.count_if(d <= 30).alias("d30"), F.count_if((d > 30) & (d <= 90)).alias("d90"), F.count_if((d > 90) & (d <= 365)).alias("d365"), F.count_if(d > 365).alias("longer"))


def default_retention(kind: Column) -> Column:
    return score.lookup(kind, vocab.RETENTION_DAYS, vocab.RETENTION_FALLBACK)


def compactable(chunks: DataFrame, as_of: Column, days: int = 30, least: int = 3, groups: int | None = 20) -> DataFrame:
    """(source_file, chunk_type, n, first_date, last_date): groups of old daily, team and other chunks, the largest first."""
    old = chunks.filter(F.col("chunk_type").isin("daily", "team", "other") & (F.col("source_date") < F.date_sub(as_of.cast("date"), days)))
    out = old.groupBy("source_file", "chunk_type").agg(F.count("*").alias("n"), F.min("source_date").alias("first_date"), F.max("source_date").alias("last_date")).filter(F.col("n") >= least)
    return out.orderBy(F.desc("n"), "source_file", "chunk_type").limit(groups) if groups else out


def first_sentence(body: Column) -> Column:
    """The first sentence of more than ten characters, else the first 100 characters."""
    parts = F.filter(F.transform(F.split(body, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    return F.coalesce(F.get(parts, F.lit(0)), F.substring(body, 1, 100))


def compact(chunks: DataFrame, as_of: Column, days: int = 30, least: int = 3, groups: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """(summaries, remaining chunks): each group becomes one row with its chunks' first sentences."""
    found = compactable(chunks, as_of, days, least, groups)
    keys = ["source_file", "chunk_type"]
    members = chunks.filter(F.col("source_date") < F.date_sub(as_of.cast("date"), days)).join(found, keys)
    lines = F.array_sort(F.collect_list(F.struct("id", first_sentence(F.col("chunk_text")).alias("s"))))
    summary = members.groupBy(*keys).agg(F.count("*").alias("n"), lines.alias("ls"))
    summaries = summary.select(*keys, "n", F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["s"])), "\n").alias("chunk_text"))
    return summaries, chunks.join(members.select("id"), "id", "left_anti")


def merge_reread(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of re-read files: one row for each fingerprint of the new reading, with what is known of an equal old chunk
    (tier, access_count, importance; of several the smallest id's) and its action: kept, added; old chunks of the same files without a match: removed.

    Old chunks of files that were not re-read are not touched."""
    mark = lambda df: df.withColumn("fp", text.fingerprint(F.col("source_file"), F.col("chunk_text")))
    one = lambda df: df.groupBy("fp").agg(F.min_by(F.struct(*(c for c in df.columns if c != "fp")), "id").alias("r")).select("fp", "r.*")
    a = one(mark(old.join(new.select("source_file").distinct(), "source_file", "left_semi"))).select("fp", F.col("id").alias("old_id"), F.col("source_file").alias("of"), F.col("tier").alias("old_tier"), F.col("access_count").alias("old_access"))
    b = one(mark(new)).select("fp", F.col("id").alias("new_id"), F.col("source_file").alias("nf"))
    action = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "added").otherwise("kept")
    return a.join(b, "fp", "full_outer").select("fp", F.coalesce("nf", "of").alias("source_file"), "old_id", "new_id", action.alias("action"), F.coalesce("old_tier", F.lit("peripheral")).alias("tier"), F.coalesce("old_access", F.lit(0)).alias("access_count"))


def accesses(found: DataFrame, as_of: Column) -> DataFrame:
    """(id, accessed_at) rows for the access log: one for each chunk that a search has returned."""
    return found.select("id", as_of.alias("accessed_at"))


def accessed(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """chunks with the log's accesses added to their count, and their last access no earlier than the log's last one."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("accessed_at").alias("_last"))
    count = (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")
    last = F.greatest(F.col("last_accessed_at").cast("timestamp"), "_last")
    return chunks.join(seen, "id", "left").withColumns({"access_count": count, "last_accessed_at": last}).drop("_n", "_last")


def to_share(chunks: DataFrame, agent: str, kinds: list[str], reason: str, as_of: Column) -> DataFrame:
    """Rows of shared_chunks for an agent's chunks of those types; nobody has pulled them yet. Equal texts are shared once."""
    own = chunks.filter((F.col("agent") == agent) & F.col("chunk_type").isin(kinds)).select("agent", "chunk_text", "chunk_type").distinct()
    return own.select(F.col("agent").alias("source_agent"), "chunk_text", "chunk_type", F.lit(None).cast("string").alias("tags"), as_of.alias("shared_at"), F.lit("").alias("propagated_to"), F.lit(reason).alias("share_reason"))


class WipeGuard(ValueError):
    """A re-read would lose too many chunks."""


def guard(merged: DataFrame, least: float = 0.9) -> None:
    n = merged.agg(F.count_if(F.col("action") != "removed").alias("after"), F.count_if(F.col("action") != "added").alias("before")).first()
    if n.before and n.after < least * n.before:
        raise WipeGuard(f"{n.after} chunks would be left of {n.before}")


def shared_for(shared: DataFrame, agent: str) -> DataFrame:
    """Rows shared by others that this agent has not pulled: propagated_to is a JSON list of agents."""
    pulled = F.array_contains(F.coalesce(F.from_json("propagated_to", "array<string>"), F.array().cast("array<string>")), agent)
    return shared.filter((F.col("source_agent") != agent) & ~pulled)


def procedures(rows: DataFrame) -> DataFrame:
    """Success rates (two digits) of procedures with a JSON list of validations [{"ok": true}, ...]."""
    all_ = F.coalesce(F.from_json("validations", "array<struct<ok:boolean>>"), F.array().cast("array<struct<ok:boolean>>"))
    good = F.size(F.filter(all_, lambda v: v["ok"]))
    return rows.withColumn("runs", F.size(all_)).withColumn("success_rate", F.when(F.size(all_) > 0, score.round2(good / F.when(F.size(all_) > 0, F.size(all_)))))


def contradictions(chunks: DataFrame, newest: int = 30, least: int = 5) -> DataFrame:
    """(decision_id, lesson_id, shared): the newest decisions and lessons that share words of five letters or more, counted as
    often as the lesson has them, of which exactly one is a negative statement."""
    rank = F.row_number().over(Window.partitionBy("chunk_type").orderBy(F.desc("id")))
    new = chunks.filter(F.col("chunk_type").isin("decision", "lesson")).withColumn("r", rank).filter(F.col("r") <= newest)
    words = F.filter(F.split(F.lower("chunk_text"), r"\s+"), lambda w: F.length(w) > 4)
    told = new.select("id", "chunk_type", words.alias("ws"), F.col("chunk_text").rlike(vocab.NEGATION).alias("neg"))
    d = told.filter("chunk_type = 'decision'").select(F.col("id").alias("decision_id"), F.col("neg").alias("dn"), F.explode(F.array_distinct("ws")).alias("w"))
    m = told.filter("chunk_type = 'lesson'").select(F.col("id").alias("lesson_id"), F.col("neg").alias("ln"), F.explode("ws").alias("w"))
    return d.join(m, "w").groupBy("decision_id", "lesson_id", "dn", "ln").agg(F.count("*").alias("shared")).filter((F.col("shared") >= least) & (F.col("dn") != F.col("ln"))).select("decision_id", "lesson_id", "shared")


def topics(chunks: DataFrame, as_of: Column, days: int = 14, least: int = 3) -> DataFrame:
    """(word, n): words of six letters or more in recent decisions."""
    recent = chunks.filter((F.col("chunk_type") == "decision") & (F.col("source_date") >= F.date_sub(as_of.cast("date"), days)))
    words = recent.select(F.explode(F.split(F.lower("chunk_text"), r"\s+")).alias("word")).filter((F.length("word") > 5) & ~F.col("word").rlike(vocab.TOPIC_STOP))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def exact_copies(chunks: DataFrame) -> DataFrame:
    """(fp, kept_id, n): groups of equal texts and the smallest id of each."""
    return chunks.groupBy(F.sha2("chunk_text", 256).alias("fp")).agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1")


def near_copies(new: DataFrame, index: DataFrame, threshold: float = 0.7, vectors: DataFrame | None = None, least: float = 0.85, hits: int = 5) -> DataFrame:
    """Ingest check: new rows (id, chunk_text) that are like an indexed chunk.

    vectors (id, embedding): a new row with a vector is compared by cosine with its `hits` best lexical hits for its first
    eight words; hits without a vector are passed over. Then the columns are (id, match_id, cosine, overlap), one of the
    last two null. Rows without a vector, or all if none are given, (id, match_id, overlap): those whose first eight words of
    four letters or more overlap an indexed chunk by more than the threshold (share of the new row's words). Fewer than
    three such words: no duplicate."""
    if vectors is not None:
        held = vectors.filter("embedding is not null and size(embedding) > 0")
        own = held.join(new.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("own"))
        first = F.regexp_replace(F.regexp_extract("chunk_text", r"^\s*+(\S++(?:\s++\S++){0,7})", 1), r"\s+", " ")
        asked = stored(new.select("id", first.alias("query")).join(held.select("id"), "id", "left_semi").withColumnRenamed("id", "query_id"), "queries")
        found = search.bm25(asked, index, limit=hits + 1).filter("id <> query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("base_rank"))
        top = found.withColumn("p", place).filter(F.col("p") <= hits).join(held, "id").join(own, "query_id")
        like = top.filter(F.size("own") == F.size("embedding")).withColumn("cosine", search.cosine(F.col("own"), F.col("embedding"))).filter(F.col("cosine") >= least)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("p"))
        same = like.withColumn("r", best).filter("r = 1").select(F.col("query_id").alias("id"), F.col("id").alias("match_id"), F.round("cosine", 6).alias("cosine"), F.lit(None).cast("double").alias("overlap"))
        rest = _overlapping(_eight_words(new).join(held.select("id"), "id", "left_anti"), index, threshold)
        return same.unionByName(rest.withColumn("cosine", F.lit(None).cast("double")))
    return _overlapping(_eight_words(new), index, threshold)


def _words(chunks: DataFrame, body: Column) -> DataFrame:
    """(id, words): texts to be split into words of four characters or more (_hashed())."""
    return chunks.select("id", text.caseless(F.coalesce(body, F.lit(""))).alias("words"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return hashes.in_lists(batches, ["words"], hashes.SPACED, 4)


def _eight_words(chunks: DataFrame) -> DataFrame:
    """(id, ws): hashes of a text's first eight words, if three are different."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hashed(batches):
            flat, at = batch.column("words").values.to_numpy(), batch.column("words").offsets.to_numpy()
            of = np.flatnonzero(np.diff(at) >= 3)
            place = np.minimum(np.arange(8), np.diff(at)[of, None] - 1)  # the last one again where there are fewer
            rows = np.sort(flat[at[of, None] + place], axis=1)
            new = np.diff(rows, axis=1, prepend=rows[:, :1]) != 0
            new[:, 0] = True
            keep = new.sum(1) >= 3
            rows, new = rows[keep], new[keep]
            ends = np.concatenate([[0], new.sum(1).cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of[keep])), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[new]))], ["id", "ws"])

    begin = F.substring("chunk_text", 1, 512)  # is enough for most texts
    asked = _words(chunks, F.when(F.regexp_count(begin, F.lit(r"\S{4,}+\s")) >= 8, begin).otherwise(F.col("chunk_text")))
    return asked.mapInArrow(read, f"id {asked.schema['id'].dataType.simpleString()}, ws array<long>")


def _overlapping(probes: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    probe = stored(probes.select("id", F.xxhash64("ws").alias("key"), "ws"), "probes")
    # rows that ask for the same words ask once; the two best of each are kept, as one may be the row itself
    asked = probe.groupBy("key").agg(F.first("ws").alias("ws"))
    met = blocks.in_passes(asked, _words(index, F.col("chunk_text")), lambda sent: _sharing(sent, threshold), "key long, match_id long, shared int, n int", sent=_packed)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "match_id"))
    top = met.groupBy("key", "match_id", "n").agg(F.max("shared").alias("shared")).withColumn("p", rank).filter("p <= 2")
    like = probe.select("id", "key").join(top, "key").filter("id <> match_id").select("id", "match_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "match_id"))
    return like.filter(F.col("overlap") > threshold).withColumn("r", best).filter("r = 1").select("id", "match_id", "overlap")


def _packed(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return rows.column("key").to_numpy(), *blocks.packed(rows.column("ws"))


def _sharing(sent: Broadcast, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over batches of texts (id, words): the two that share most words with each of the sets sent, if more than the threshold."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known, sets = sent.value
        n = (sets < len(known)).sum(1)
        spare = n - (np.floor(threshold * n + 1e-9).astype(int) + 1)
        two, held = blocks.Two(len(sets)), np.zeros(len(known) + 1, np.int64)
        for turn, (block, _) in enumerate(blocks.blocks(known, _hashed(batches), {"words": 1.0}), 1):
            held += block.count[block.row]
            if turn & (turn - 1) == 0:  # by what has been read so far, words of few texts come first
                parts = np.array_split(sets, -(-len(sets) // blocks.LOOKED_UP))
                sets = np.concatenate([np.take_along_axis(p, np.argsort(held[p], axis=1, kind="stable"), 1) for p in parts])
            # two texts before this block's stand unless one here lacks fewer words
            stands = two.ids.max(1) < block.ids[0]
            found, lacking, text = blocks.fullest(block, sets, np.where(stands, np.minimum(spare, two.lacking[:, 1].astype(int) - 1), spare))
            two.add(found, lacking, block.ids[text])
        at, which = np.nonzero(two.lacking < two.NONE)
        for lo in range(0, len(at), 1 << 16):
            i, j = at[lo : lo + (1 << 16)], which[lo : lo + (1 << 16)]
            shared = n[i] - two.lacking[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(two.ids[i, j]), pa.array(shared.astype(np.int32)), pa.array(n[i].astype(np.int32))], ["key", "match_id", "shared", "n"])

    return search
