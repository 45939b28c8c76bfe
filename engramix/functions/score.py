"""Salience and boosts as column expressions. Every clock is an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramix import vocab


def lookup(key: Column, values: dict, default: object) -> Column:
    """values[key], or default; a CASE, so it stays in generated code."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp01(x: Column) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def round2(x: Column) -> Column:
    """Halves towards positive infinity, for negative numbers too."""
    return F.floor(x * 100 + 0.5) / 100


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(as_of: Column, last_accessed: Column, source_date: Column, created: Column, retention: Column, kind: Column) -> Column:
    """Halves every retention period; 1 where it never decays, 0.5 without a date."""
    days = F.coalesce(retention.cast("double"), lookup(kind, {k: float(v) for k, v in vocab.RECENCY_DAYS.items()}, float(vocab.RECENCY_FALLBACK)))
    when = F.coalesce(last_accessed.cast("timestamp"), source_date.cast("timestamp"), created.cast("timestamp"))
    age = F.greatest(F.lit(0.0), days_between(as_of, when))
    return F.when(days <= 0, 1.0).when(when.isNull(), 0.5).otherwise(F.pow(F.lit(2.0), -age / F.when(days > 0, days)))


def importance(explicit: Column, kind: Column) -> Column:
    return F.coalesce(clamp01(explicit), lookup(kind, vocab.IMPORTANCE, vocab.IMPORTANCE_FALLBACK))


def pain(value: Column) -> Column:
    return F.coalesce(clamp01(value), F.lit(vocab.PAIN_FALLBACK))


def access(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).cast("double")) / math.log(1000))


def salience(as_of: Column, c: dict[str, Column]) -> Column:
    """0.55 importance + 0.15 recency + 0.10 pain + 0.20 access, within 0 and 1."""
    r = recency(as_of, c["last_accessed_at"], c["source_date"], c["created_at"], c["retention_days"], c["chunk_type"])
    return clamp01(0.55 * importance(c["importance"], c["chunk_type"]) + 0.15 * r + 0.10 * pain(c["pain"]) + 0.20 * access(c["access_count"]))


def salience_product(as_of: Column, c: dict[str, Column]) -> Column:
    """The older rule: recency x pain x importance."""
    r = recency(as_of, c["last_accessed_at"], c["source_date"], c["created_at"], c["retention_days"], c["chunk_type"])
    return r * pain(c["pain"]) * importance(c["importance"], c["chunk_type"])


def salience_class(s: Column) -> Column:
    return F.when(s >= 0.7, "promote").when(s >= 0.4, "retain").when(s >= 0.15, "review").otherwise("archive")


def infer_pain(kind: Column, text: Column) -> Column:
    base = lookup(kind, vocab.PAIN, vocab.PAIN_FALLBACK)
    return F.when(F.coalesce(text.rlike(vocab.INCIDENT), F.lit(False)), clamp01(base + 0.5)).otherwise(base)


def type_delta(kind: Column, delta: float) -> Column:
    return F.when(kind.isin(vocab.BOOSTED_TYPES), delta).otherwise(0.0)


def recency_delta(as_of: Column, source_date: Column, delta: float) -> Column:
    return F.when(source_date.cast("date") >= F.date_sub(as_of.cast("date"), 7), delta).otherwise(0.0)


def source_delta(source_type: Column, section: Column, entities: Column) -> Column:
    """Factor - 1; none where the chunk's section already ranks it, unless the query names several entities."""
    return F.when(section.isin(*vocab.SECTION_FACTOR) & (entities <= 1), 0.0).otherwise(lookup(source_type, {k: v - 1 for k, v in vocab.SOURCE_FACTOR.items()}, 0.0))


def section_delta(section: Column, boost: Column, factors: dict[str, float] | None = None) -> Column:
    return F.coalesce(lookup(section, factors or vocab.SECTION_FACTOR, None), boost, F.lit(1.0)) - 1


def tier_delta(tier: Column) -> Column:
    return lookup(tier, {k: v - 1 for k, v in vocab.TIER_FACTOR.items()}, 0.0)
