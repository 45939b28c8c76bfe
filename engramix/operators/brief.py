"""Session briefings: a pool by a cheap proxy, exact salience, novelty, near-copies out, quotas, a token budget."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import score, text
from engramix.operators.lifecycle import with_salience

POOL = 500
WINDOW_HOURS = 72
#: Pain from which a chunk is never penalised or pushed out; slots for fresh chunks, and their age in days.
PAIN_FLOOR, FRESH_SLOTS, FRESH_DAYS = 0.9, 2, 7


def prefixes(scope: str, agent: str | None = None) -> list[str]:
    """Beginnings of the paths of a scope (`global`: all paths, no prefix) and of an agent's sessions."""
    own = [] if scope == "global" else [f"memory/mac-docs/{scope}/", f"shared/imports/Claude/Projetos/{scope}/", f"shared/imports/{scope}/", f"{scope}/"]
    return own + ([f"sessions/{agent}/"] if agent else [])


def under(chunks: DataFrame, begin: list[str]) -> DataFrame:
    """Chunks whose path begins with one of these; all if there are none."""
    return chunks.filter(reduce(lambda a, b: a | b, [F.startswith("source_file", F.lit(p)) for p in begin])) if begin else chunks


def pool(chunks: DataFrame, as_of: Column, agent: str | None = None, scope: str | None = None, since: Column | None = None, size: int = POOL) -> DataFrame:
    """The `size` best chunks by 0.55 importance + 0.10 pain + 0.1 if read, newest first among equals, with exact salience.

    agent: value of the agent column; scope: text in the path, metacharacters as they are; since: the oldest source_date."""
    own = chunks
    if agent is not None:
        own = own.filter(F.col("agent") == agent)
    if scope is not None:
        own = own.filter(F.contains(F.lower("source_file"), F.lit(scope.lower())))
    if since is not None:
        own = own.filter(F.col("source_date") >= since)
    proxy = 0.55 * F.coalesce("importance", F.lit(0.5)) + 0.10 * F.coalesce("pain", F.lit(0.2)) + F.when(F.coalesce("access_count", F.lit(0)) > 0, 0.1).otherwise(0.0)
    top = own.withColumn("proxy", F.round(proxy, 9)).orderBy(F.desc("proxy"), F.desc("created_at"), "id").limit(size)
    return with_salience(top, as_of)


def serves(log: DataFrame, as_of: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    """(chunk_id, serves) within the hours before as_of."""
    age = score.days_between(as_of, F.col("served_at")) * 24
    return log.filter((age >= 0) & (age <= hours)).groupBy("chunk_id").agg(F.count("*").alias("serves"))


def novelty(rows: DataFrame, served: DataFrame) -> DataFrame:
    """brief_score: salience minus min(0.15, 0.05 ln(1 + serves)); nothing off if pain is 0.9 or more."""
    joined = rows.join(served.withColumnRenamed("chunk_id", "id"), "id", "left")
    off = F.when(F.coalesce("pain", F.lit(0.2)) >= 0.9, 0.0).otherwise(F.least(F.lit(0.15), 0.05 * F.log1p(F.coalesce("serves", F.lit(0)).cast("double"))))
    return joined.withColumn("penalty", F.round(off, 6)).withColumn("brief_score", F.round(F.col("salience") - off, 6))


def fresh(chunks: DataFrame, served: DataFrame, as_of: Column, days: int = FRESH_DAYS, slots: int = FRESH_SLOTS) -> DataFrame:
    """The newest (by source_date, else created_at) important or painful chunks that were not served lately."""
    weighty = (F.col("importance") >= 0.7) | (F.col("pain") >= 0.7)
    day = F.coalesce(F.col("source_date").cast("timestamp"), F.col("created_at").cast("timestamp"))
    own = chunks.filter(weighty & (score.days_between(as_of, day) <= days)).join(served, F.col("id") == F.col("chunk_id"), "left_anti")
    return own.orderBy(day.desc(), F.desc("importance"), "id").limit(slots)


def titled(rows: DataFrame) -> DataFrame:
    line = text.one_liner(F.coalesce("chunk_text", F.lit("")))
    return rows.withColumns({"title": text.title_of(F.col("source_file")), "line": line})


class _Chosen:
    """Rows that are picked one by one: none with an id, or with the title and line, of an earlier one, and none whose tokens
    mostly are those of one."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.ids: set[int] = set()
        self.shown: set[tuple[str, str]] = set()
        self.tokens: list[set[str]] = []

    def add(self, row: dict, fresh: bool = False) -> bool:
        shown = row["title"], row["line"]
        if row["id"] in self.ids or shown in self.shown:
            return False
        own = {t for t in re.split(r"[^\w.]+|_", " ".join(shown).lower()) if len(t) >= 4}
        if len(own) >= 3 and any(len(s) >= 3 and len(own & s) >= 0.6 * min(len(own), len(s)) for s in self.tokens):
            return False
        self.ids.add(row["id"])
        self.shown.add(shown)
        self.tokens.append(own)
        self.rows.append(row | {"fresh": fresh})
        return True

    def fill(self, rows: list[dict], most: int, upto: int, fresh: bool = False) -> None:
        """Adds rows in order, `most` of them, until there are `upto` in all."""
        for row in rows:
            if most <= 0 or len(self.rows) >= upto:
                return
            most -= self.add(row, fresh)


def choose(pools: list[list[dict]], quotas: list[int], n: int, by: str, new: list[dict] | None = None, slots: int = 0, pinned: frozenset[int] = frozenset()) -> list[dict]:
    """n rows of the pools (each in order of salience), best `by` first: pinned ones; each pool's quota; what one pool lacks from the
    others; new ones in the slots; the rest from the pools."""
    order = lambda rows: sorted(rows, key=lambda r: (-r[by], r["id"]))
    rows = order([r for pool in pools for r in pool])
    out, main = _Chosen(), max(0, n - slots)
    out.fill([r for r in rows if r["id"] in pinned], n, n)
    for pool, quota in zip(pools, quotas, strict=True):
        out.fill(pool, quota, main)
    out.fill(rows, n, main)
    out.fill(new or [], slots, n, fresh=True)
    out.fill(rows, n, n)
    return order(out.rows)


_COLUMNS = "id long, title string, line string, chunk_type string, pain double, salience double, brief_score double, age_days int"


def build(chunks: DataFrame, log: DataFrame, as_of: Column, scope: str, agent: str | None = None, n: int = 10, since: Column | None = None, slots: int = FRESH_SLOTS) -> DataFrame:
    """(place, id, title, line, chunk_type, pain, salience, brief_score, age_days, fresh, tokens, change): the brief, and with place
    null what it leaves out of the one by salience alone.

    With an agent half of the rows are from its sessions, half from the scope. Chunks that were served lately lose score,
    `slots` rows are for fresh ones, and chunks with a pain of 0.9 or more that salience alone would choose are kept.
    change: `would_enter` for rows that salience alone would not choose, `would_leave` for the opposite."""
    served = serves(log, as_of)
    ways = [prefixes("global", agent), prefixes(scope)] if agent else [prefixes(scope)]
    quotas = [-(-n // 2), n // 2] if agent else [n]
    age = F.greatest(F.lit(0), F.floor(score.days_between(as_of, F.coalesce(F.col("source_date").cast("timestamp"), F.col("created_at").cast("timestamp"))))).cast("int")
    shape = lambda df, name: titled(df).select(F.lit(name).alias("pool"), "id", "title", "line", "chunk_type", F.coalesce("pain", F.lit(0.2)).alias("pain"), F.round("salience", 9).alias("salience"), "brief_score", F.coalesce(age, F.lit(0)).alias("age_days"))
    rows = None
    for i, begin in enumerate(ways):
        part = shape(novelty(pool(under(chunks, begin), as_of, since=since), served), i)
        rows = part if rows is None else rows.unionByName(part)
    new = with_salience(fresh(under(chunks, prefixes(scope, agent)), served, as_of, slots=max(1, 4 * slots)), as_of)
    rows = rows.unionByName(shape(new.withColumn("brief_score", F.round("salience", 6)), len(ways)))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        every = frame.sort_values(["salience", "id"], ascending=[False, True]).to_dict("records")
        pools = [[r for r in every if r["pool"] == i] for i in range(len(ways))]
        plain = choose(pools, quotas, n, "salience")
        pinned = frozenset(r["id"] for r in plain if r["pain"] >= PAIN_FLOOR)
        late = sorted((r for r in every if r["pool"] == len(ways)), key=lambda r: (r["age_days"], -r["salience"], r["id"]))
        now = choose(pools, quotas, n, "brief_score", late, slots, pinned)
        before, after = {r["id"] for r in plain}, {r["id"] for r in now}
        out = [(i, *(r[c.split()[0]] for c in _COLUMNS.split(", ")), r["fresh"], -(-(len(r["title"]) + len(r["line"]) + 24) // 4), None if r["id"] in before else "would_enter") for i, r in enumerate(now, 1)]
        out += [(None, *(r[c.split()[0]] for c in _COLUMNS.split(", ")), False, 0, "would_leave") for r in plain if r["id"] not in after]
        names = ["place", *(c.split()[0] for c in _COLUMNS.split(", ")), "fresh", "tokens", "change"]
        return pd.DataFrame(out, columns=names).astype({"place": "Int32"})

    return rows.groupBy(F.lit("brief")).applyInPandas(pick, f"place int, {_COLUMNS}, fresh boolean, tokens int, change string")  # two pools and the new rows


def within_budget(rows: DataFrame, budget: int = 1200, by: list[str] | None = None) -> DataFrame:
    """The first rows (place, tokens) that fit the budget together; without `by`, of a brief (few rows)."""
    run = F.sum("tokens").over(Window.partitionBy(*(by or []), F.lit(1)).orderBy("place"))
    return rows.filter("place is not null").withColumn("upto", run).filter(F.col("upto") <= budget)


def differences(served_now: DataFrame, served_before: DataFrame) -> DataFrame:
    """(id, change): ids that would enter and leave."""
    enter = served_now.select("id").exceptAll(served_before.select("id")).withColumn("change", F.lit("would_enter"))
    return enter.unionByName(served_before.select("id").exceptAll(served_now.select("id")).withColumn("change", F.lit("would_leave")))
