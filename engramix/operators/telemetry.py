"""Telemetry: run statistics, comparisons of periods, proposals, audit states, health, costs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import score
from engramix.operators.lifecycle import kth


def ranked_value(rows: DataFrame, value: str, place: Column, by: list[str]) -> DataFrame:
    """([by], value) of the element at `place` (from 1; may use `total`) of each group, without sorting a group in one task."""
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return kth(counts, place, by).withColumnRenamed("v", value)


def command_stats(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """(command, total, success, avg_ms, p95_ms, last_ts) of runs (command, status, duration_ms, ts) with start < ts < end.

    p95 is the largest of fewer than 20 runs, else the element ceil(0.95 n) in order."""
    own = runs.filter((F.col("ts") > start) & (F.col("ts") < end))
    base = own.groupBy("command").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), (F.floor(F.avg("duration_ms") * 10 + 0.5) / 10).alias("avg_ms"), F.max("ts").alias("last_ts"))
    place = F.when(F.col("total") < 20, F.col("total")).otherwise(F.ceil(F.col("total") * 95 / 100))
    high = ranked_value(own, "duration_ms", place, ["command"]).withColumnRenamed("duration_ms", "p95_ms")
    return base.join(high, "command")


def dormant(runs: DataFrame, as_of: Column, days: int = 30, least: int = 3) -> DataFrame:
    """(command, runs, idle_days) of commands that were in use but not for `days`."""
    out = runs.groupBy("command").agg(F.count("*").alias("runs"), F.max("ts").alias("last"))
    idle = F.round(score.days_between(as_of, F.col("last")), 0)
    return out.select("command", "runs", idle.alias("idle_days")).filter((F.col("idle_days") >= days) & (F.col("runs") >= least))


def proposals(runs: DataFrame, as_of: Column, days: int = 7, base_days: int = 30) -> DataFrame:
    """(command, rule, level, value) comparing the last days with those before: slower, more or fewer errors, busier, first use,
    dormant."""
    now_from = F.timestamp_add("DAY", F.lit(-days), as_of)
    cur = command_stats(runs, now_from, as_of)
    old = command_stats(runs, F.timestamp_add("DAY", F.lit(-base_days), as_of), now_from)
    side = lambda df, p: df.select("command", *(F.col(c).alias(f"{p}_{c}") for c in ("total", "success", "p95_ms")))
    both = side(cur, "c").join(side(old, "o"), "command", "full_outer")
    ratio = F.col("c_p95_ms") / F.when(F.col("o_p95_ms") > 0, F.col("o_p95_ms"))
    rate = lambda p: F.col(f"{p}_success") / F.col(f"{p}_total")
    points = (rate("c") - rate("o")) * 100
    busier = (F.col("c_total") / days) / (F.col("o_total") / (base_days - days))
    rule = lambda ok, name, level, v: F.when(ok, F.struct(F.lit(name).alias("rule"), level.alias("level"), F.round(v.cast("double"), 6).alias("value")))
    rules = F.array_compact(
        F.array(
            rule(ratio >= 2, "slower", F.when(ratio >= 4, "alert").otherwise("warn"), ratio),
            rule(points <= -10, "errors", F.when(points <= -25, "alert").otherwise("warn"), points),
            rule(points >= 10, "recovery", F.lit("info"), points),
            rule(busier >= 3, "busier", F.when(busier >= 10, "alert").otherwise("warn"), busier),
            rule(F.col("o_total").isNull(), "first_use", F.lit("info"), F.col("c_total")),
        )
    )
    found = both.select("command", F.explode(rules).alias("r")).select("command", "r.rule", "r.level", "r.value")
    idle = dormant(runs, as_of).select("command", F.lit("dormant").alias("rule"), F.when(F.col("idle_days") >= 60, "warn").otherwise("info").alias("level"), F.col("idle_days").cast("double").alias("value"))
    return found.unionByName(idle)


def search_rollup(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row over the searches (ts, latency_ms, results_count, has_semantic) of the last hours; p95 at max(1, floor(0.95 n))."""
    own = log.filter((F.col("ts") >= F.timestamp_add("HOUR", F.lit(-hours), as_of)) & (F.col("ts") <= as_of)).withColumn("g", F.lit(1))
    base = own.groupBy("g").agg(F.count("*").alias("searches"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.round(F.count_if("has_semantic") / F.count("*"), 6).alias("semantic_share"), F.count_if(F.col("results_count") == 0).alias("empty"))
    high = ranked_value(own, "latency_ms", F.greatest(F.lit(1), F.floor(F.col("total") * 95 / 100)), ["g"]).withColumnRenamed("latency_ms", "p95_ms")
    return base.join(high, "g").drop("g")


def daily_counters(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """(date, one column for each kind) from facts (ts, kind): counters that are derived, not updated."""
    return facts.groupBy(F.to_date("ts").alias("date")).pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0)


def audit_breakdown(audit: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(db_source, success, failed, crashed, running) of operations started in the last hours, without test operations."""
    own = audit.filter((score.days_between(as_of, F.col("started_at")) * 24).between(0, hours) & ~F.col("op_name").startswith("test-"))
    by = F.coalesce("db_source", F.lit("unknown")).alias("db_source")
    return own.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "crashed", "running")))


def reaped(audit: DataFrame, as_of: Column, alive: list[int], hours: int = 6) -> DataFrame:
    """Running operations older than the hours whose process is gone become crashed."""
    dead = (F.col("status") == "running") & (score.days_between(as_of, F.col("started_at")) * 24 > hours) & ~F.col("pid").isin(alive)
    return audit.withColumn("status", F.when(dead, "crashed").otherwise(F.col("status")))


def latest_states(events: DataFrame) -> DataFrame:
    """(op_id, status, at): the last state of each operation of an append-only log (op_id, status, at)."""
    return events.groupBy("op_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def drifted(rows: DataFrame, stamp: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows whose time stamp is further from the clock than the hours."""
    return rows.filter(F.abs(score.days_between(as_of, F.col(stamp))) * 24 > hours)


def provider_costs(calls: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(provider, calls, usd, success_rate) of the last hours and a row `all`; without calls `all` has a rate of 1."""
    own = calls.filter((score.days_between(as_of, F.col("ts")) * 24).between(0, hours))
    sums = [F.count("*").alias("calls"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("usd"), F.round(F.coalesce(F.count_if("ok") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 6).alias("success_rate")]
    return own.groupBy("provider").agg(*sums).unionByName(own.agg(*sums).withColumn("provider", F.lit("all")))


def token_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """usd of each call (model, tokens_in, tokens_out) by prices for a million tokens (model, price_in, price_out); unknown: 0."""
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return calls.join(prices, "model", "left").withColumn("usd", F.coalesce(F.round(cost, 9), F.lit(0.0))).drop("price_in", "price_out")


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, those with a vector, and vectors without a chunk."""
    ids = vectors.select("id").distinct()
    has = chunks.select("id", F.lit(1).alias("c")).join(ids.withColumn("v", F.lit(1)), "id", "full_outer")
    return has.agg(F.count("c").alias("total"), F.count_if(F.col("c").isNotNull() & F.col("v").isNotNull()).alias("embedded"), F.count_if(F.col("c").isNull()).alias("orphans"))


def health(numbers: DataFrame) -> DataFrame:
    """Levels from (coverage, canary_ok, failed, ops): ok, warn, critical."""
    share = F.col("failed") / F.when(F.col("ops") > 0, F.col("ops"))
    vector = F.when(F.col("coverage") >= 0.95, "ok").when(F.col("coverage") >= 0.8, "warn").otherwise("critical")
    ops = F.when(F.coalesce(share, F.lit(0.0)) < 0.05, "ok").when(share < 0.2, "warn").otherwise("critical")
    return numbers.withColumns({"vector_level": vector, "canary_level": F.when(F.col("canary_ok"), "ok").otherwise("critical"), "ops_level": ops})


def deltas(snapshots: DataFrame, hours: int = 24) -> DataFrame:
    """(ts, value, change) against the latest snapshot (ts, value) that is at least so old, found by an as-of window."""
    # by day of the snapshot: the one sought is the last of the same or the day before that is old enough, else the last of the
    # latest day before; days are few, their snapshots are looked at day by day
    step = F.expr(f"INTERVAL {hours} HOURS")
    own = snapshots.select("ts", "value", F.to_date("ts").alias("day"))
    days = own.groupBy("day").agg(F.max_by("value", "ts").alias("last"))
    order = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    asked = own.withColumn("upto", F.col("ts") - step).withColumn("on", F.to_date("upto"))
    same = asked.join(own.select(F.col("day").alias("on"), F.col("ts").alias("t"), F.col("value").alias("v")), "on").filter("t <= upto").groupBy("ts", "value").agg(F.max_by("v", "t").alias("was"))
    covered = asked.join(same, ["ts", "value"], "left")
    # without one of that day: the last of the latest day before it
    known = days.select("day").union(asked.select("on")).distinct()
    upto = known.join(days, "day", "left").withColumn("before", F.last("last", ignorenulls=True).over(order)).select(F.col("day").alias("on"), "before")
    return covered.join(upto, "on", "left").select("ts", "value", (F.col("value") - F.coalesce("was", "before")).alias("change"))


def agent_profiles(chunks: DataFrame, top: int = 5) -> DataFrame:
    """(agent, chunks, last_date, dominant, types) with the most frequent types first."""
    by = chunks.groupBy("agent", "chunk_type").agg(F.count("*").alias("n"), F.max("source_date").alias("last"))
    r = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "chunk_type"))
    ranked = by.withColumn("r", r)
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "chunk_type", "n")))), lambda x: F.concat_ws(":", x["chunk_type"], x["n"].cast("string"))), ",")
    return ranked.groupBy("agent").agg(F.sum("n").alias("chunks"), F.max("last").alias("last_date"), F.max(F.when(F.col("r") == 1, F.col("chunk_type"))).alias("dominant"), types.alias("types"))


class Queue:
    """Rows of telemetry on their way to a sink: at most `capacity` wait, of more the oldest go. put() never waits for the sink;
    drain() hands over what is there, and a row that the sink refuses is counted and dropped."""

    def __init__(self, write: Callable[[dict], None], capacity: int = 500) -> None:
        self.rows: deque[dict] = deque(maxlen=capacity)
        self.write, self.dropped, self.refused = write, 0, 0

    def put(self, row: dict) -> None:
        self.dropped += len(self.rows) == self.rows.maxlen
        self.rows.append(row)

    def drain(self) -> int:
        done = 0
        while self.rows:
            try:
                self.write(self.rows.popleft())
                done += 1
            except Exception:  # the sink's own fault
                self.refused += 1
        return done


def newest_rows(rows: DataFrame, order: str, capacity: int = 500) -> DataFrame:
    """What a Queue of the rows would hold: the newest `capacity` by `order`."""
    return rows.orderBy(F.desc(order)).limit(capacity)
