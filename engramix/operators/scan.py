"""Predicates and reads of stored tables, as filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(column: Column, part: str) -> Column:
    """Whether a text contains the part, whatever the case; no character of the part is a wildcard."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def begins(column: Column, part: str) -> Column:
    return F.startswith(column, F.lit(part))


def folded_in(column: Column, values: list[str]) -> Column:
    """Whether a text is one of the values, whatever the case."""
    return F.lower(column).isin(sorted({v.lower() for v in values}))


def since_days(column: Column, as_of: Column, days: int) -> Column:
    """On a day of the last `days` days, or later."""
    return column.cast("date") >= F.date_sub(as_of.cast("date"), days)


def before_days(column: Column, as_of: Column, days: int) -> Column:
    """Before the last `days` days."""
    return column.cast("date") < F.date_sub(as_of.cast("date"), days)


def between_open(column: Column, start: Column, end: Column) -> Column:
    return (column > start) & (column < end)


def two_windows(rows: DataFrame, by: str, at: str, current: tuple[Column, Column], baseline: tuple[Column, Column]) -> DataFrame:
    """(by, current, baseline): rows whose time is inside either open window."""
    return rows.groupBy(by).agg(F.count_if(between_open(F.col(at), *current)).alias("current"), F.count_if(between_open(F.col(at), *baseline)).alias("baseline"))


def json_number(column: Column, path: str, default: int | None = None) -> Column:
    """A whole number in JSON; the default where it is missing or none."""
    value = F.get_json_object(column, path).try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default))


def outcomes(rows: DataFrame, by: list[str], state: str, value: str) -> DataFrame:
    """([by], good, bad, good_sum): rows by outcome, and the value summed over successes."""
    good = F.col(state) == "success"
    return rows.groupBy(*by).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.round(F.sum(F.when(good, F.col(value))), 2).alias("good_sum"))


def page_after(rows: DataFrame, key: str, last: int, size: int = 50) -> DataFrame:
    """The next rows by key beyond `last`; the largest key of the page is the next `last`."""
    return rows.filter(F.col(key) > last).orderBy(key).limit(size)


def matching(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose text matches one of the patterns."""
    return rows.filter(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)))


def members(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """Rows whose key is in the one-column frame."""
    (own,) = among.columns
    return rows.join(among.withColumnRenamed(own, key), key, "left_semi")


def others(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """Rows whose key isn't in the one-column frame; a null there excludes nothing."""
    (own,) = among.columns
    return rows.join(among.withColumnRenamed(own, key), key, "left_anti")
