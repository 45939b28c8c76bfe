"""The driver's tables seen as memory tables, in Spark and, from the same text, in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import vocab

AS_OF = "2026-01-15"
_SECTIONS = {0: "compiled", 1: "frontmatter", 2: "timeline"}
_TIERS = {0: "core", 1: "working"}


def _pick(number: str, values: dict[int, str], default: str | None) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + (f" ELSE '{default}'" if default else "") + " END"


def _date(days: str, spark: bool) -> str:
    return f"date_add(DATE'2026-01-14', CAST(-({days}) AS INT))" if spark else f"CAST(DATE '2026-01-14' - CAST(({days}) AS INTEGER) AS DATE)"


def chunk_columns(spark: bool) -> str:
    types = dict(enumerate(vocab.CHUNK_TYPES))
    sources = dict(enumerate(vocab.SOURCE_FACTOR))
    return ", ".join(
        [
            "doc_id AS id",
            "concat('memory/', source, '/', CAST(doc_id % 97 AS VARCHAR(10)), '.md') AS source_file",
            "text AS chunk_text",
            f"{_pick('doc_id % 11', types, None)} AS chunk_type",
            f"{_date('doc_id * 7 % 400', spark)} AS source_date",
            f"{_date('400 + doc_id * 13 % 200', spark)} AS created_at",
            f"CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_date('doc_id * 3 % 120', spark)} END AS last_accessed_at",
            "CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id * doc_id % 17 END AS access_count",
            "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id * 31 % 100 AS DOUBLE) / 100 END AS importance",
            "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id * 17 % 100 AS DOUBLE) / 100 END AS pain",
            "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 30 + doc_id % 5 * 60 END AS retention_days",
            f"{_pick('doc_id % 4', _TIERS, 'peripheral')} AS tier",
            f"{_pick('doc_id % 13', _SECTIONS, None)} AS section",
            "CASE WHEN doc_id % 17 = 0 THEN CAST(1.2 AS DOUBLE) ELSE NULL END AS section_boost",
            f"{_pick('doc_id % 15', sources, None)} AS source_type",
            "concat('agent', CAST(doc_id % 4 AS VARCHAR(10))) AS agent",
        ]
    )


def now() -> Column:
    """The clock of all queries."""
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.selectExpr(*split_columns(chunk_columns(True)))


def split_columns(columns: str) -> list[str]:
    """Top-level columns of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


#: Oracle's chunks; a query's SQL goes on with ", x AS (...) SELECT ..." or " SELECT ...".
CHUNKS = f"WITH chunks AS (SELECT {chunk_columns(False)} FROM documents)"
# A triple store from the star schema: suppliers supply parts, suppliers and customers are in nations.
ENTITIES = """entities AS (
  SELECT s_suppkey * 10 + 1 AS id, s_name AS name, 'supplier' AS entity_type, s_suppkey % 23 AS mention_count FROM supplier
  UNION ALL SELECT p_partkey * 10 + 2, p_name, 'part', p_partkey % 19 FROM part
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 3, n_name, 'nation', CAST(n_nationkey AS BIGINT) + 5 FROM nation)"""
RELATIONS = """relations AS (
  SELECT l_suppkey * 10000000000 + l_partkey * 10 + 1 AS id, l_suppkey * 10 + 1 AS source_id, 'uses' AS relation_type, l_partkey * 10 + 2 AS target_id,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE round(max(l_discount), 2) + 0.5 END AS confidence,
    CASE l_partkey % 5 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'mentions' WHEN 2 THEN 'extends' ELSE 'unknown' END AS reason, count(*) AS evidence
  FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT s_suppkey * 10 + 2, s_suppkey * 10 + 1, 'in', CAST(s_nationkey AS BIGINT) * 10 + 3, CAST(0.8 AS DOUBLE), 'derived_from', 1 FROM supplier)"""
GRAPH = f"WITH {ENTITIES}, {RELATIONS}"


#: Rows that are grouped or joined in one task, on average.
GROUPED = 500_000


def parts(spark: SparkSession, rows: int) -> int | None:
    """Into how many parts so many rows are dealt out, if a shuffle into spark.sql.shuffle.partitions parts would give a task more than
    GROUPED: a task's memory doesn't grow with the table then."""
    n = -(-rows // GROUPED)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def in_groups(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by its columns if it is large (parts()): a GROUP BY of them then needs no other shuffle. Counts the rows (for
    Parquet, from the files' footers)."""
    n = parts(df.sparkSession, df.count())
    return df.repartition(n, *by) if n else df


def graph_parts(spark: SparkSession, folder: str) -> int | None:
    """parts() of the graph's larger table. Relations are no more than the rows that they are made of, which needn't be grouped to be counted."""
    rows = {n: table(spark, folder, n).count() for n in ("supplier", "part", "nation", "lineitem")}
    return parts(spark, rows["supplier"] + max(rows["lineitem"], rows["part"] + rows["nation"]))


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations), by the same SQL as the oracle's."""
    names = ["supplier", "part", "nation", "lineitem"]
    frames = {n: table(spark, folder, n) for n in names}
    frames["lineitem"] = in_groups(frames["lineitem"], "l_suppkey", "l_partkey")
    plain = lambda sql: sql.split(" AS (", 1)[1].rsplit(")", 1)[0]
    fill = lambda sql: spark.sql(_braced(plain(sql), names), **{n: frames[n] for n in names if f"FROM {n}" in sql})
    return fill(ENTITIES), fill(RELATIONS)


def _braced(sql: str, names: list[str]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return sql
