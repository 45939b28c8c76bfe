"""URL filters with dated lists: an as-of join of captures with the list entries active when they were fetched.
DataFrame functions only.

A list's dated entries (host added, host removed) become validity intervals; an interval holds from an addition to the
next removal. A capture meets the intervals of its host and of the domains above it that hold at its time. Intervals and
captures are also cut by periods of time, so neither a host with many captures nor one with many entries makes long
runs of pairs: each capture meets the intervals of one host in one period only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a period.
PERIOD = 32
_FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host name of a URL with a scheme, without trailing dots; an IPv6 address keeps its brackets. Empty or null otherwise."""
    return _plain(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1))


def _plain(host: Column) -> Column:
    return F.rtrim(F.lower(host), F.lit("."))


def domains_of(host: Column) -> Column:
    """The host and the domains above it that have two labels or more; an address is itself alone."""
    labels = F.when(host.rlike(r"^\[|^\d+(\.\d+){3}$"), F.array(host)).otherwise(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _period(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("2000-01-01").cast("date")) / PERIOD)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, start, end) from entries (list, host, day, action): active on day if start <= day < end. Hosts are compared
    in lower case without trailing dots.

    action is `add` or `remove`. Of several entries for a list and host on one day a removal wins. Entries with a null in
    any column take no part; additions while active and removals while inactive change nothing."""
    # one row for each day on which something happens
    days = entries.filter("list is not null and host is not null and day is not null and action in ('add', 'remove')").groupBy("list", _plain(F.col("host")).alias("host"), "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("off"))
    # the next event, found in the event's own period or, for its last event, as the first of the next period that has one
    cut = days.withColumn("period", _period(F.col("day")))
    inside = Window.partitionBy("list", "host", "period").orderBy("day")
    firsts = cut.groupBy("list", "host", "period").agg(F.min("day").alias("first"))
    following = firsts.select("list", "host", "period", F.lead("first").over(Window.partitionBy("list", "host").orderBy("period")).alias("next_first"))
    local = cut.withColumn("next_here", F.lead("day").over(inside))
    ended = local.join(following, ["list", "host", "period"]).filter("off = 0")
    return ended.select("list", "host", F.col("day").alias("start"), F.coalesce("next_here", "next_first", F.lit(_FOREVER).cast("date")).alias("end"))


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """One row for each capture: its id, url, host, fetch day, blocked (boolean), lists (sorted names, joined by commas), n_lists.

    A capture is blocked if an entry for its host or a domain above it is active on the day of the fetch. Captures
    with a null or unreadable url, or no fetch day, match nothing. Repeated rows are judged one by one; ids may be null.
    An empty list blocks nothing; an empty table of captures gives no rows."""
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("day"))
    # equal hosts and days are judged once, however many captures they have
    asked = own.filter("host <> '' and day is not null").select("host", "day").distinct()
    probes = asked.select("host", "day", F.explode(domains_of(F.col("host"))).alias("domain"), _period(F.col("day")).alias("period"))
    held = intervals(entries)
    # an interval is spread over the periods that have captures, however far they are and however long it holds
    periods = own.filter("day is not null").agg(F.collect_set(_period(F.col("day"))).alias("periods"))  # one row
    within = F.filter("periods", lambda p: (p >= _period(F.col("start"))) & (p <= _period(F.col("end"))))
    spread = held.crossJoin(F.broadcast(periods)).select("list", F.col("host").alias("domain"), "start", "end", F.explode(within).alias("period"))
    met = probes.join(spread, ["domain", "period"]).filter("start <= day and day < end")
    found = met.groupBy("host", "day").agg(F.array_sort(F.collect_set("list")).alias("names"))
    judged = own.join(found, ["host", "day"], "left")
    return judged.select(F.col("id").alias(id_col), "url", "host", F.col("day").alias("fetched"), F.col("names").isNotNull().alias("blocked"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("lists"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_lists"))


# The tables have neither fetch times nor lists; both are derived from ids and host names by arithmetic.


def dated_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr("date_add(date'2023-01-01', cast(pmod(page_id * 37, 730) as int))").alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """For a quarter of all hosts and domains: three additions and two removals on one of three lists."""
    names = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("host")).filter("host <> ''").distinct()
    m = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")
    chosen = names.withColumn("m", m).filter("m % 4 = 0")
    steps = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(d).alias("shift")) for a, d in (("add", 0), ("remove", 90), ("add", 200), ("add", 230), ("remove", 400))))
    each = chosen.select("host", "m", F.explode(steps).alias("s"))
    return each.select(F.concat(F.lit("list"), (F.floor(F.col("m") / 4) % 3).cast("string")).alias("list"), "host", F.expr("date_add(date'2023-01-01', cast(floor(m / 12) % 300 + s.shift as int))").alias("day"), "s.action")


#: DuckDB SQL for the query: the last event up to the fetch decides.
ORACLE = r"""
WITH captures AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1)), '.') AS host,
    DATE '2023-01-01' + CAST(((page_id * 37) % 730 + 730) % 730 AS INTEGER) AS fetched FROM pages),
split AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^\[|^\d+(\.\d+){3}$') THEN [host] ELSE string_split(host, '.') END AS l FROM captures WHERE host <> ''),
domains AS (
  SELECT host, array_to_string(l[i:len(l)], '.') AS domain
  FROM (SELECT host, l, unnest(range(1, greatest(2, len(l)))) AS i FROM split)),
chosen AS (
  SELECT DISTINCT domain, CAST('0x' || substr(md5(domain), 1, 7) AS BIGINT) AS m FROM domains),
events AS (
  SELECT 'list' || CAST((m // 4) % 3 AS VARCHAR) AS list, domain, DATE '2023-01-01' + CAST((m // 12) % 300 + shift AS INTEGER) AS day, action
  FROM chosen, (VALUES ('add', 0), ('remove', 90), ('add', 200), ('add', 230), ('remove', 400)) s(action, shift) WHERE m % 4 = 0),
met AS (
  SELECT c.host, c.fetched, e.list, arg_max(e.action, e.day) AS action
  FROM (SELECT DISTINCT host, fetched FROM captures) c JOIN domains d USING (host) JOIN events e ON e.domain = d.domain AND e.day <= c.fetched
  GROUP BY c.host, c.fetched, e.list, e.domain),
found AS (
  SELECT host, fetched, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(DISTINCT list) AS n_lists FROM met WHERE action = 'add' GROUP BY 1, 2)
SELECT page_id, url, host, CAST(fetched AS VARCHAR) AS fetched, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(n_lists, 0) AS n_lists
FROM captures LEFT JOIN found USING (host, fetched)
"""
