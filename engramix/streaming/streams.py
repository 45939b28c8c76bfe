"""Structured Streaming: watched folders, idempotent events, windows over telemetry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramix import vocab
from engramix.functions import score, text
from engramix.operators import extract


def watch_files(spark: SparkSession, root: str, per_trigger: int = 100) -> DataFrame:
    """A stream of (source_file, text, modified) of new and changed .md and .txt files up to 5 MB."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").option("maxFilesPerTrigger", per_trigger).load(root)
    return files.filter(F.col("length") <= 5 << 20).select(F.col("path").alias("source_file"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def latest_of_each(batch: DataFrame) -> DataFrame:
    """The newest version of each file of a micro-batch, in place of a debounce; of versions of one time the last by text."""
    r = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("modified"), F.desc("text")))
    return batch.withColumn("_r", r).filter("_r = 1").drop("_r")


def told(*columns: str) -> Column:
    """None of the columns is null, as one predicate: its parts alone would be moved below the watermark, whose clock rows they drop."""
    return ~F.array_contains(F.array(*(F.col(c).isNull() for c in columns)), True)


def settled(changes: DataFrame, quiet: str = "2 seconds", delay: str = "1 second", time: str = "modified", keys: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """A debounce: ([keys], the other columns of the newest change, changes, first) once for each run of changes of a key, after no
    change has come for longer than `quiet`.

    Of changes of one time the last by the other columns counts; rows with a null key or time say nothing but what time it is (see
    clock()). A stream holds a row for each run that is open, in its checkpoint, and ends a run once its time has passed by `delay`;
    changes that come later than that are dropped. A batch ends all runs."""
    own = changes.withWatermark(time, delay) if changes.isStreaming else changes
    own = own.filter(told(*keys, time))
    others = [c for c in changes.columns if c not in keys]
    newest = F.max(F.struct(F.col(time).alias("_time"), *(F.col(c) for c in others)))
    runs = own.groupBy(F.session_window(time, quiet).alias("w"), *keys).agg(newest.alias("r"), F.count("*").alias("changes"))
    return runs.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others), "changes", F.col("w.start").alias("first"))


def clock(changes: DataFrame, time: str = "modified", per_second: int = 1) -> DataFrame:
    """The stream with rows that hold the time alone, so that the last change of a quiet folder settles too."""
    ticks = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return changes.unionByName(ticks.select(*(F.col("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields)))


def allowed(hour: int, forbidden: tuple[int, int] | None) -> bool:
    """Whether a batch may run at this hour of the day; forbidden: (from, to) hours, over midnight if from is the larger."""
    if forbidden is None or forbidden[0] == forbidden[1]:
        return True
    first, last = forbidden
    inside = first <= hour < last if first < last else hour >= first or hour < last
    return not inside


def allowed_at(hour: Column, forbidden: tuple[int, int]) -> Column:
    """allowed() of a column of hours."""
    return hour.isin([h for h in range(24) if allowed(h, forbidden)])


class Forbidden(RuntimeError):
    """A batch came in hours in which none may run; the stream ends, and goes on from its checkpoint later."""


def run_ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, forbidden: tuple[int, int] | None = None, hour: Callable[[], int] | None = None) -> StreamingQuery:
    """Each micro-batch's newest files go to `handle`; runs until all that is there is done or, with `every` (an interval), on and on.

    No batch runs in the forbidden hours; hour gives the time of day (UTC by default)."""
    clock = hour or (lambda: dt.datetime.now(dt.UTC).hour)

    def run(batch: DataFrame, n: int) -> None:
        if not allowed(clock(), forbidden):
            raise Forbidden(f"batch {n} at {clock()} h")
        handle(latest_of_each(batch), n)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def once_only(events: DataFrame, time: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("kind", "session_id", "seq")) -> DataFrame:
    """Events without those that repeat an earlier one's keys within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def new_events(events: DataFrame, store: DataFrame) -> DataFrame:
    """The batch side of the same rule: events whose (kind, session_id, seq) the store's JSON metadata doesn't hold."""
    held = store.select(*(F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("kind", "session_id")), F.coalesce(F.get_json_object("metadata", "$.seq"), F.lit("0")).alias("seq"))
    own = events.withColumn("seq", F.coalesce(F.col("seq").cast("string"), F.lit("0"))).dropDuplicates(["kind", "session_id", "seq"])
    return own.join(held, ["kind", "session_id", "seq"], "left_anti")


def checked(events: DataFrame) -> DataFrame:
    """events (kind, session_id, content, scope, host, seq) with `error`: null, or why an event isn't taken in."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    bad = lambda c, shape: given(c) & ~text.valid(F.col(c), shape)
    reason = F.when(~F.coalesce(F.col("kind").isin(*vocab.EVENT_KINDS), F.lit(False)), "kind").when(~text.valid(F.trim("session_id"), vocab.SESSION_ID), "session_id")
    reason = reason.when(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == "", "content").when(F.octet_length("content") > vocab.EVENT_BYTES, "content")
    return events.withColumn("error", reason.when(bad("scope", vocab.SCOPE), "scope").when(bad("host", vocab.HOST), "host").when(bad("seq", vocab.SEQ), "seq"))


def taken_in(events: DataFrame, store: DataFrame, as_of: Column) -> DataFrame:
    """Chunks (source_file, chunk_text, chunk_type, source_date, retention_days, metadata) of the valid events that the store's
    metadata doesn't hold yet: redacted, under a heading, in a file of their session."""
    good = checked(events).filter("error is null").withColumn("session_id", F.trim("session_id"))
    own = new_events(good, store).withColumn("r", extract.event_secrets(F.col("content")))
    scope, host = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in (("scope", "unscoped"), ("host", "unknown")))
    seq = F.nullif(F.nullif(F.col("seq"), F.lit("")), F.lit("0"))
    head = score.lookup(F.col("kind"), vocab.EVENT_KINDS, None)
    day = as_of.cast("date")
    return own.select(
        F.concat(F.lit("events/"), host, F.lit("/"), scope, F.lit("/"), "session_id", F.coalesce(F.concat(F.lit("-"), seq), F.lit("")), F.lit(".md")).alias("source_file"),
        F.concat(F.lit("## "), head, F.lit(" — "), scope, F.lit(" ("), host, F.lit(", "), day.cast("string"), F.lit(")\n\n"), "r.text").alias("chunk_text"),
        F.lit("daily").alias("chunk_type"),
        day.alias("source_date"),
        F.lit(vocab.RETENTION_DAYS["daily"]).alias("retention_days"),
        F.to_json(F.struct(F.lit("ingest-event").alias("source"), "kind", "session_id", seq.alias("seq"), scope.alias("scope"), host.alias("host"), F.col("r.count").alias("redaction_count"))).alias("metadata"),
    )


def tumbling(events: DataFrame, length: str = "1 day", delay: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, by, n, total) of each window; the same for a batch and a stream (late events beyond the delay are dropped there)."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    return own.groupBy(F.window("ts", length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    return own.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with gaps below `gap`."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
