"""Reports: small results of aggregates, rendered as text by their caller or here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramix.functions import text

DIGEST_TYPES = ["decision", "lesson", "person", "project", "pending", "daily"]


def digest_rows(chunks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(week, id, line) of the last days' notable chunks."""
    own = chunks.filter(F.col("chunk_type").isin(DIGEST_TYPES) & (F.col("source_date") >= F.date_sub(F.to_date(as_of), days)))
    return own.select(text.iso_week(F.to_date(as_of)).alias("week"), "id", F.concat(F.lit("["), "chunk_type", F.lit("] "), "chunk_text").alias("line"))


def decision_line(body: Column) -> Column:
    """The first line that states a decision, up to 120 characters; null without one."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    bullet = lambda x: x.startswith("- **") & (F.length(x) > 20)
    named = lambda x: x.rlike(r"^\*\*Decis[ãa]o:\*\*")
    header = lambda x: x.rlike(r"^## \d{4}-\d{2}-\d{2} — .+") & (F.length(x) > 20)
    first = F.get(F.filter(lines, lambda x: bullet(x) | named(x) | header(x)), F.lit(0))
    return F.when(bullet(first), F.substring(first, 1, 120)).otherwise(F.concat(F.lit("- "), F.substring(F.regexp_replace(first, "^## ", ""), 1, 120)))


def primer(chunks: DataFrame, as_of: Column, decisions: int = 5, today: int = 3, pending: int = 3) -> DataFrame:
    """(section, place, line): the latest distinct decisions, today's notes, what is pending."""
    recent = chunks.filter("chunk_type = 'decision'").orderBy(F.desc("id")).limit(15).select("id", decision_line(F.col("chunk_text")).alias("line")).filter("line is not null")
    parts = [
        (recent.groupBy("line").agg(F.max("id").alias("id")), "decisions", decisions),
        (chunks.filter(F.col("source_date") == F.to_date(as_of)).select("id", text.one_liner(F.col("chunk_text")).alias("line")), "today", today),
        (chunks.filter("chunk_type = 'pending'").select("id", text.one_liner(F.col("chunk_text")).alias("line")), "pending", pending),
    ]
    out = None
    for rows, name, n in parts:
        top = rows.orderBy(F.desc("id")).limit(n)
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.desc("id")))  # n rows at most
        part = top.select(F.lit(name).alias("section"), place.alias("place"), "line")
        out = part if out is None else out.unionByName(part)
    return out


def profile(entities: DataFrame, chunks: DataFrame, as_of: Column, top: int = 20, days: int = 30) -> DataFrame:
    """(section, name, n): the most mentioned entities, active projects, decisions of the last days."""
    best = entities.orderBy(F.desc("mention_count"), "id").limit(top).select(F.lit("entities").alias("section"), "name", F.col("mention_count").cast("long").alias("n"))
    since = F.date_sub(F.to_date(as_of), days)
    recent = chunks.filter(F.col("source_date") >= since)
    projects = recent.filter("chunk_type = 'project'").groupBy(text.title_of(F.col("source_file")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("projects").alias("section"), "name", "n")
    decisions = recent.filter("chunk_type = 'decision'").select(F.lit("decisions").alias("section"), text.one_liner(F.col("chunk_text")).alias("name"), F.lit(1).cast("long").alias("n"))
    return best.unionByName(projects).unionByName(decisions)


def doctor(chunks: DataFrame, vectors: DataFrame, done: DataFrame) -> DataFrame:
    """(check, ok, detail): vectors for all chunks, no failed consolidations (source_file, status)."""
    n, v = chunks.agg(F.count("*").alias("n")), vectors.select("id").distinct().join(chunks.select("id"), "id", "left_semi").agg(F.count("*").alias("v"))
    index = n.crossJoin(v).select(F.lit("vectors").alias("check"), (F.col("n") == F.col("v")).alias("ok"), F.concat_ws(" of ", F.col("v").cast("string"), F.col("n").cast("string")).alias("detail"))  # one row each
    states = done.agg(F.count_if(F.col("status") == 1).alias("good"), F.count_if(F.col("status") == -1).alias("bad"))
    return index.unionByName(states.select(F.lit("consolidation").alias("check"), (F.col("bad") == 0).alias("ok"), F.concat(F.col("good").cast("string"), F.lit(" done, "), F.col("bad").cast("string"), F.lit(" failed")).alias("detail")))


def gaps(chunks: DataFrame, guides: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """(agent, id): recent lessons that name an agent whose guide (agent, guide) holds fewer than two of their first five long words."""
    lessons = chunks.filter((F.col("chunk_type") == "lesson") & (F.col("source_date") >= F.date_sub(F.to_date(as_of), days))).select("id", F.lower("chunk_text").alias("t"))
    words = F.slice(F.filter(F.split("t", r"\s+"), lambda w: F.length(w) > 5), 1, 5)
    told = lessons.select("id", words.alias("ws"), F.explode(F.array_distinct(F.split("t", r"[^\p{L}\p{N}_-]+"))).alias("name"))
    met = told.join(guides.select("agent", F.lower("agent").alias("name"), F.lower("guide").alias("guide")), "name")
    return met.filter(F.size(F.filter("ws", lambda w: F.contains(F.col("guide"), w))) < 2).select("agent", "id")


def strengths(chunks: DataFrame, least: int = 50) -> DataFrame:
    """(agent, n) of agents with more than `least` chunks."""
    return chunks.groupBy("agent").agg(F.count("*").alias("n")).filter(F.col("n") > least)


def formatted(rows: DataFrame, *keep: str) -> DataFrame:
    """Search results (rank, score, chunk_type, source_file, chunk_text) as lines."""
    return rows.select(*keep, "rank", F.format_string("%d. [%s] %s (%.2f)\n   %s", "rank", "chunk_type", "source_file", F.col("score").cast("double"), text.one_liner(F.col("chunk_text"))).alias("line"))
