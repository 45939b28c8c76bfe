"""Queries over text and vectors: scans, scalar functions, search, ranking, de-duplication."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import storage, vocab
from engramix.functions import chunkers, score, text
from engramix.operators import lifecycle, search
from engramix.operators.index import SearchIndex, content_of
from engramix.plans.registry import ORACLES, query
from engramix.plans.views import AS_OF, CHUNKS, chunks, now, table
from engramix.sources import files
from engramix.vocab import case_sql

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _indexed(spark: SparkSession, folder: str, by: list[str] | None = None) -> dict:
    """The arguments of a search over the stored index of the folder's chunks, which is brought up to date first: a search after the
    first reads its terms' postings only, until the table's files change."""
    content = content_of(spark, f"{folder}/documents.parquet")
    key = spark.sparkContext.applicationId, folder
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex(spark, storage.new_folder(spark, "index"), ["agent"])
    _INDEXES[key].refresh(chunks(spark, folder), content)
    return _INDEXES[key].of(content, by)


def _asked(spark: SparkSession, *queries: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


# --- scans, ingest ---------------------------------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'memory/entities/persons/a.md' WHEN 1 THEN 'cache/ocr/b.md' WHEN 2 THEN 'sessions/c.jsonl' WHEN 3 THEN 'x/memory/lessons/d.md' WHEN 4 THEN 'notes/e-lessons.md' ELSE source END AS path FROM documents) "
    "SELECT doc_id, path, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{k}'" for p, k in vocab.PATH_KINDS) + " ELSE 'other' END AS source_type, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{k}'" for p, k in vocab.TYPE_OF_PATH) + " ELSE 'other' END AS chunk_type FROM p"
)
def a02_classified_paths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr("doc_id", "CASE doc_id % 6 WHEN 0 THEN 'memory/entities/persons/a.md' WHEN 1 THEN 'cache/ocr/b.md' WHEN 2 THEN 'sessions/c.jsonl' WHEN 3 THEN 'x/memory/lessons/d.md' WHEN 4 THEN 'notes/e-lessons.md' ELSE source END AS path")
    return docs.select("doc_id", "path", text.path_kind(F.col("path")).alias("source_type"), text.chunk_type(F.col("path")).alias("chunk_type"))


_NL = "chr(10) || chr(10)"
_COUNTED = r"len(regexp_split_to_array({}, '\s+'))"
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "WITH md AS (SELECT doc_id, concat('## One', chr(10), text, chr(10), '## Two', chr(10), 'short ', source, chr(10), '### Three', chr(10), replace(text, '. ', '.' || " + _NL + ")) AS t FROM documents), "
    r"cut AS (SELECT doc_id, list_filter([" + _STRIPPED.format("x") + r" for x in string_split(regexp_replace(t, '(^|\n)(#{2,3}[^\S\n])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: x <> '') AS ss FROM md), "
    "sec AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM cut), "
    # long sections: paragraphs are added to what is held as long as it has 500 words at most
    "par AS (SELECT doc_id, i, s, " + _COUNTED.format("s") + r" AS n, [{'done': CAST([] AS VARCHAR[]), 'held': p} for p in regexp_split_to_array(s, '\n\n+') if length(trim(p)) > 0] AS ps FROM sec), "
    "packed AS (SELECT doc_id, i, s, n, CASE WHEN n > 500 THEN list_reduce(ps, lambda a, p: CASE WHEN " + _COUNTED.format("a.held || " + _NL + " || p.held") + " > 500 THEN {'done': list_append(a.done, " + _STRIPPED.format("a.held") + "), 'held': p.held} ELSE {'done': a.done, 'held': a.held || " + _NL + " || p.held} END) END AS f FROM par), "
    "made AS (SELECT doc_id, i, {'out': CASE WHEN n > 500 THEN list_append(f.done, " + _STRIPPED.format("f.held") + ") ELSE [s] END, 'short': n < 20} AS x FROM packed), "
    "folded AS (SELECT doc_id, list_reduce(list(x ORDER BY i), lambda a, b: {'out': CASE WHEN b.short THEN list_append(a.out[1:len(a.out) - 1], a.out[len(a.out)] || " + _NL + " || b.out[1]) ELSE list_concat(a.out, b.out) END, 'short': false}) AS x FROM made GROUP BY doc_id) "
    "SELECT doc_id, unnest(range(0, len(x.out))) AS pos, md5(unnest(x.out)) AS chunk FROM folded"
)
def a07_markdown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under headings: as they are, a short section, and with a paragraph for each sentence."""
    chunkers.register(spark)
    md = table(spark, folder, "documents").select("doc_id", F.expr("concat('## One\\n', text, '\\n## Two\\nshort ', source, '\\n### Three\\n', replace(text, '. ', '.\\n\\n'))").alias("t"))
    return spark.sql("SELECT d.doc_id, CAST(c.pos AS BIGINT) AS pos, md5(c.chunk) AS chunk FROM {d} d, LATERAL chunk_markdown(d.t) c", d=md)


@query("SELECT event_id, CAST(0 AS INTEGER) AS pos, 'k: ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS chunk FROM events")
def a08_json_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunkers.register(spark)
    return spark.sql("SELECT e.event_id, c.pos, c.chunk FROM {e} e, LATERAL chunk_json(e.props) c", e=table(spark, folder, "events"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def a09_mojibake(spark: SparkSession, folder: str) -> DataFrame:
    broken = table(spark, folder, "documents").withColumn("text", F.replace("text", F.lit("é"), F.lit("Ã©")))
    return broken.select("doc_id", F.md5(text.mojibake_repaired(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, 'memory/2026-0' || CAST(1 + doc_id % 9 AS VARCHAR) || '-1' || CAST(doc_id % 10 AS VARCHAR) || '.md' AS path, '2026-0' || CAST(1 + doc_id % 9 AS VARCHAR) || '-1' || CAST(doc_id % 10 AS VARCHAR) AS day FROM documents")
def a10_path_dates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr("doc_id", "concat('memory/2026-0', 1 + doc_id % 9, '-1', doc_id % 10, '.md') AS path")
    return docs.select("doc_id", "path", text.path_date(F.col("path")).cast("string").alias("day"))


@query(CHUNKS + " SELECT id, chunk_type FROM chunks WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def a16_missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return files.missing_vectors(chunks(spark, folder), _vectors(spark, folder)).select("id", "chunk_type")


@query(
    CHUNKS + ", m AS (SELECT id, source_file, tier, access_count, substr(sha256(source_file || chr(0) || chunk_text), 1, 32) AS fp FROM chunks), "
    "new AS (SELECT fp, min(id) AS new_id, min(source_file) AS nf FROM m WHERE id % 10 > 2 GROUP BY fp), "
    "old AS (SELECT fp, min(id) AS old_id, min(source_file) AS f FROM m WHERE id % 10 < 7 AND source_file IN (SELECT source_file FROM m WHERE id % 10 > 2) GROUP BY fp) "
    "SELECT coalesce(nf, f) AS source_file, CASE WHEN new_id IS NULL THEN 'removed' WHEN old_id IS NULL THEN 'added' ELSE 'kept' END AS action, count(*) AS n FROM old FULL OUTER JOIN new USING (fp) GROUP BY 1, 2"
)
def a18_merge_reread(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return lifecycle.merge_reread(c.filter("id % 10 < 7"), c.filter("id % 10 > 2")).groupBy("source_file", "action").agg(F.count("*").alias("n"))


@query(CHUNKS + ", l AS (SELECT user_id AS id, count(*) AS n, max(CAST(ts AS TIMESTAMP)) AS last FROM events WHERE event_type = 'view' GROUP BY 1) SELECT id, CAST(access_count + coalesce(n, 0) AS INTEGER) AS access_count, epoch_us(greatest(CAST(last_accessed_at AS TIMESTAMP), last)) AS last_us FROM chunks LEFT JOIN l USING (id)")
def a19_access_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all chunks after the accesses that a log holds; events stand for it."""
    log = lifecycle.accesses(table(spark, folder, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), F.col("ts"))
    return lifecycle.accessed(chunks(spark, folder), log).select("id", "access_count", F.unix_micros("last_accessed_at").alias("last_us"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM documents")
def h01_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.sanitized_query(F.col("text")).alias("q"))


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def h02_folded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.entity_key(F.col("text")).alias("key"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE), 6) AS ratio FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def h03_levenshtein(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    b = table(spark, folder, "part").select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.levenshtein_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


_SHINGLES = r"list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END)"


@query(
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(left(text, 180)), '\s+'), lambda t: t <> '') AS w FROM documents), s AS (SELECT doc_id, " + _SHINGLES + " AS s FROM w) "
    "SELECT a.doc_id, len(a.s) AS n, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1"
)
def h04_shingle_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "documents").select("doc_id", text.shingles(F.col("text")).alias("s"))
    other = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(other, "doc_id").select("doc_id", F.size("s").cast("long").alias("n"), F.round(text.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(
    r"WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(source || ' ' || left(text, 140)), '[^\p{L}\p{N}.]+'), lambda t: length(t) >= 4)) AS s FROM documents) "
    "SELECT a.doc_id, CASE WHEN len(a.s) < 3 OR len(b.s) < 3 THEN CAST(0 AS DOUBLE) ELSE round(len(list_intersect(a.s, b.s)) / CAST(least(len(a.s), len(b.s)) AS DOUBLE), 6) END AS contained FROM s a JOIN s b ON b.doc_id = a.doc_id + 1"
)
def h05_containment(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "documents").select("doc_id", text.signature(F.col("source"), F.substring("text", 1, 140)).alias("s"))
    other = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(other, "doc_id").select("doc_id", F.round(text.containment(F.col("s"), F.col("t")), 6).cast("double").alias("contained"))


@query(
    r"WITH l AS (SELECT page_id, [trim(replace(regexp_replace(regexp_replace(x, '^#{1,6}\s+', ''), '^[-*>]\s+', ''), '**', '')) for x in [trim(regexp_replace(regexp_replace(y, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) for y in string_split(html, chr(10))] if x <> '' AND x <> '---' AND x <> '```'] AS ls FROM pages), "
    "f AS (SELECT page_id, coalesce(list_filter(ls, lambda x: x <> '')[1], '') AS t FROM l) SELECT page_id, CASE WHEN length(t) > 140 THEN left(t, 139) || '…' ELSE t END AS line FROM f"
)
def h06_one_liners(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.one_liner(F.col("html")).alias("line"))


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS q, substr(sha256(text), 1, 16) AS a, substr(sha256(source || chr(0) || text), 1, 32) AS f FROM documents")
def h07_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.query_hash(F.col("text")).alias("q"), F.substring(F.sha2("text", 256), 1, 16).alias("a"), text.fingerprint(F.col("source"), F.col("text")).alias("f"))


_PLAIN_FACTS = [(k, p) for k, p in vocab.FACTS if k != "proper_noun"]
# names are bounded by anything but letters, digits and underscores; marks are doubled, so that two names may share one between them
_NAMES = "(?:^|[^\\p{L}\\p{N}_])(" + dict(vocab.FACTS)["proper_noun"].removeprefix(r"\b").removesuffix(r"\b") + ")(?:$|[^\\p{L}\\p{N}_])"


@query(
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 0{', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''})) AS match FROM documents".replace("'(?i)", "'") for k, p in _PLAIN_FACTS)
    + rf" UNION ALL SELECT doc_id, 'proper_noun', unnest(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_\s])', '\1\1', 'g'), '{_NAMES}', 1)) FROM documents"
    + ") SELECT doc_id, kind, trim(match) AS match, count(*) AS n FROM m GROUP BY ALL"
)
def h08_facts(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", F.explode(text.facts(F.col("text"))).alias("f")).select("doc_id", "f.kind", "f.match")
    return found.groupBy("doc_id", "kind", "match").agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, '[' || '{\"type\":\"projects\",\"slug\":\"p' || doc_id || '\",\"source\":\"markdown_link\"}' || CASE WHEN doc_id % 3 > 0 THEN ',{\"type\":\"decisions\",\"slug\":\"' || source || '\",\"source\":\"wikilink\"}' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ',{\"type\":\"lessons\",\"slug\":\"l-' || lang || '\",\"source\":\"bare_ref\"}' ELSE '' END || ']' AS links, 'src/' || lang || '/b.py:' || doc_id AS code FROM documents"
)
def h09_links(spark: SparkSession, folder: str) -> DataFrame:
    md = "concat('See [x](entities/projects/p', doc_id, '.md)', CASE WHEN doc_id % 3 > 0 THEN concat(' and [[decisions/', source, '|D]]') ELSE ' and `[[decisions/code]]`' END, CASE WHEN doc_id % 2 = 0 THEN concat(' or lessons/l-', lang, ',') ELSE '' END, ' not `agents/z`. src/', lang, '/b.py:', doc_id, '\\n', text)"
    docs = table(spark, folder, "documents").withColumn("md", F.expr(md))
    return docs.select("doc_id", F.to_json(text.links(F.col("md"))).alias("links"), F.array_join(text.code_refs(F.col("md")), ",").alias("code"))


_INTENT = "CASE doc_id % 5 WHEN 0 THEN concat('what happened on 20', 10 + doc_id % 15, '-0', 1 + doc_id % 9, '-1', doc_id % 10, '?') WHEN 1 THEN concat('deploys in ', CASE doc_id % 2 WHEN 0 THEN 'march' ELSE 'abril de' END, ' 20', 10 + doc_id % 15) WHEN 2 THEN concat('when did ', source, ' break') WHEN 3 THEN concat('plans for 20', 10 + doc_id % 15) ELSE concat('plain ', lang, ' words') END"


@query(
    f"WITH q AS (SELECT doc_id, CAST(2010 + doc_id % 15 AS INTEGER) AS y, {_INTENT} AS q FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'iso_date' WHEN 1 THEN 'month_year' WHEN 2 THEN 'adverbial' WHEN 3 THEN 'year' END AS source, "
    r"CASE doc_id % 5 WHEN 0 THEN regexp_extract(q, '(\d{4}-\d{2}-\d{2})', 1) WHEN 1 THEN CAST(CASE WHEN contains(q, 'march') THEN make_date(y, 3, 16) ELSE make_date(y, 4, 15) END AS VARCHAR) WHEN 3 THEN CAST(make_date(y, 6, 30) AS VARCHAR) END AS anchor FROM q"
)
def h12_temporal_intent(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "documents").select("doc_id", F.expr(_INTENT).alias("q"))
    return q.select("doc_id", text.temporal_intent(F.col("q"), now()).alias("i")).select("doc_id", "i.source", F.col("i.anchor").cast("string").alias("anchor"))


_RECENCY = (
    "CASE WHEN d <= 0 THEN CAST(1 AS DOUBLE) ELSE pow(CAST(2 AS DOUBLE), -greatest(0, date_diff('day', w, DATE '" + AS_OF + "')) / d) END"
)
_SALIENT = (
    CHUNKS + ", t AS (SELECT *, coalesce(CAST(retention_days AS DOUBLE), " + case_sql("chunk_type", {k: float(v) for k, v in vocab.RECENCY_DAYS.items()}, float(vocab.RECENCY_FALLBACK)) + ") AS d, coalesce(last_accessed_at, source_date, created_at) AS w, "
    "coalesce(importance, " + case_sql("chunk_type", vocab.IMPORTANCE, vocab.IMPORTANCE_FALLBACK) + ") AS i, coalesce(pain, CAST(0.2 AS DOUBLE)) AS p FROM chunks), r AS (SELECT *, " + _RECENCY + " AS rec FROM t), "
    "s AS (SELECT *, greatest(0, least(1, CAST(0.55 AS DOUBLE) * i + CAST(0.15 AS DOUBLE) * rec + CAST(0.10 AS DOUBLE) * p + CAST(0.20 AS DOUBLE) * least(1, ln(1 + access_count) / ln(1000)))) AS salience, rec * p * i AS salience_product FROM r)"
)


@query(_SALIENT + " SELECT id, round(salience, 6) AS salience, round(salience_product, 6) AS salience_product, CASE WHEN salience_product >= 0.7 THEN 'promote' WHEN salience_product >= 0.4 THEN 'retain' WHEN salience_product >= 0.15 THEN 'review' ELSE 'archive' END AS salience_class FROM s")
def i07_salience(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.with_salience(chunks(spark, folder), now()).select("id", F.round("salience", 6).alias("salience"), F.round("salience_product", 6).alias("salience_product"), "salience_class")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '(incident|outage|critical|\\bp0\\b)', 'i') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS pain FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'An Outage of ' WHEN 1 THEN 'P0: ' ELSE '' END || text AS t FROM documents)")
def h15_inferred_pain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr("doc_id", "concat(CASE doc_id % 3 WHEN 0 THEN 'An Outage of ' WHEN 1 THEN 'P0: ' ELSE '' END, text) AS t")
    return docs.select("doc_id", F.round(score.infer_pain(F.lit("decision"), F.col("t")), 6).alias("pain"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1) AS found, CASE WHEN doc_id % 4 = 1 THEN CAST(1 + doc_id % 1000 AS INTEGER) END AS days FROM documents")
def h16_retention_override(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr("doc_id", "concat('# t\n', CASE doc_id % 4 WHEN 0 THEN '<!-- retention: never -->' WHEN 1 THEN concat('<!-- retention: ', 1 + doc_id % 1000, ' days -->') WHEN 2 THEN '<!-- retention: 99999 -->' ELSE 'no' END, '\n', text) AS t")
    return docs.select("doc_id", text.retention_override(F.col("t")).alias("o")).select("doc_id", "o.found", "o.days")


@query("SELECT o_orderkey, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week FROM orders")
def h17_iso_weeks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", text.iso_week(F.to_date("o_orderdate")).alias("week"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h18_cosine(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("b")), 5).alias("cosine"))


@query("SELECT l_orderkey, l_linenumber, floor((l_discount * l_tax - CAST(0.003 AS DOUBLE)) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS rounded FROM lineitem")
def h23_rounding(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", score.round2(F.col("l_discount") * F.col("l_tax") - 0.003).cast("double").alias("rounded"))


@query("WITH v AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'mentioned_in' WHEN 'click' THEN 'requires' WHEN 'purchase' THEN 'Supersedes' ELSE event_type END AS verb, CASE WHEN event_id % 3 = 0 THEN 'Opposes' ELSE 'unknown' END AS raw FROM events) SELECT event_id, CASE WHEN raw = 'Opposes' THEN 'opposes' WHEN verb = 'mentioned_in' THEN 'mentions' WHEN verb = 'requires' THEN 'depends_on' WHEN verb = 'Supersedes' THEN 'replaces' ELSE 'unknown' END AS reason FROM v")
def h20_relation_reasons(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "events").selectExpr("event_id", "CASE event_type WHEN 'view' THEN 'mentioned_in' WHEN 'click' THEN 'requires' WHEN 'purchase' THEN 'Supersedes' ELSE event_type END AS verb", "CASE WHEN event_id % 3 = 0 THEN 'Opposes' ELSE 'unknown' END AS raw")
    return v.select("event_id", text.relation_reason(F.col("raw"), F.col("verb")).alias("reason"))


# --- search ----------------------------------------------------------------------------------------------------------

_QUERY = "que thing"
_WORDS = {"que": "el que", "the": "the was"}
_BM25 = (
    CHUNKS
    + ", w AS (SELECT id, concat(source_file, ' ', chunk_type) AS p, "
    + _TOKENS.format("chunk_text") + " AS t, " + _TOKENS.format("source_file") + " AS f, " + _TOKENS.format("chunk_type") + " AS k FROM chunks), "
    "e AS (SELECT id, unnest(t) AS token, CAST(1.0 AS DOUBLE) AS wt FROM w UNION ALL SELECT id, unnest(f), CAST(0.5 AS DOUBLE) FROM w UNION ALL SELECT id, unnest(k), CAST(0.5 AS DOUBLE) FROM w), "
    "tf AS (SELECT id, token, sum(wt) AS wtf FROM e WHERE token IN ('no', 'para') GROUP BY 1, 2), "
    "dl AS (SELECT id, len(t) + len(f) + len(k) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
    "df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), "
    "bm AS (SELECT tf.id, sum(greatest(CAST(1e-6 AS DOUBLE), ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25, count(*) AS met FROM tf JOIN df USING (token) JOIN dl USING (id), st GROUP BY 1), "
    "top AS (SELECT id, bm25, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS base_rank FROM bm WHERE met = 2 QUALIFY base_rank <= 20)"
)
_PAIR = "no para"


@query(_BM25 + " SELECT id, round(bm25, 6) AS bm25, CAST(base_rank AS INTEGER) AS base_rank FROM top")
def i01_bm25_and(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25(_asked(spark, _PAIR), None, **_indexed(spark, folder)).select("id", F.round("bm25", 6).alias("bm25"), "base_rank")


_WORDS_ASKED = ("no", "para", "que", "los")
_BOOLEAN = _BM25.split(", top AS (")[0].replace("token IN ('no', 'para')", f"token IN {_WORDS_ASKED}").replace("sum(greatest(", "sum(CASE WHEN tf.token <> 'los' THEN 1 ELSE 0 END * greatest(").replace("count(*) AS met FROM tf", "list(tf.token) AS have FROM tf")


@query(_BOOLEAN + " SELECT id, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS INTEGER) AS base_rank FROM bm WHERE (list_contains(have, 'no') AND list_contains(have, 'para') OR list_contains(have, 'que')) AND NOT (list_contains(have, 'que') AND NOT (list_contains(have, 'no') AND list_contains(have, 'para')) AND list_contains(have, 'los')) QUALIFY base_rank <= 20")
def i01_boolean(spark: SparkSession, folder: str) -> DataFrame:
    """Two words, or one without another."""
    return search.bm25(_asked(spark, "no AND para OR que NOT los"), None, **_indexed(spark, folder)).select("id", F.round("bm25", 6).alias("bm25"), "base_rank")


def _deltas(kind: str, recent: str) -> str:
    sources = {k: v - 1 for k, v in vocab.SOURCE_FACTOR.items()}
    return (
        f"(CASE WHEN chunk_type IN ({', '.join(repr(t) for t in vocab.BOOSTED_TYPES)}) THEN {kind}::DOUBLE ELSE 0 END + CASE WHEN source_date >= DATE '{AS_OF}' - 7 THEN {recent}::DOUBLE ELSE 0 END + "
        f"CASE WHEN section IN ('compiled', 'frontmatter', 'timeline') THEN 0 ELSE {case_sql('source_type', sources, 0.0)} END + coalesce({case_sql('section', vocab.SECTION_FACTOR, None)}, section_boost, 1) - 1)"
    )


_LEXICAL = _BM25 + ", sc AS (SELECT *, floor(abs(bm25) * (1 + " + _deltas("1.0", "0.5") + ") * 100 + 0.5::DOUBLE) / 100 AS score FROM top JOIN chunks USING (id)), lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, base_rank) AS rank FROM sc)"


@query(_LEXICAL + " SELECT id, score, CAST(rank AS INTEGER) AS rank, chunk_type FROM lex WHERE rank <= 10")
def i02_lexical_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return search.lexical(_asked(spark, _PAIR), chunks(spark, folder), now(), 10, **_indexed(spark, folder)).select("id", F.col("score").cast("double").alias("score"), "rank", "chunk_type")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").filter("vec_id = 7").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))


_KNN = "knn AS (SELECT v.vec_id AS id, sqrt(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


@query(f"WITH {_KNN} SELECT id, round(distance, 5) AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS base_rank FROM knn QUALIFY base_rank <= 10")
def f02_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return search.nearest(_asked_vectors(spark, folder), _vectors(spark, folder), 10).select("id", F.round("distance", 5).alias("distance"), "base_rank")


_SEMANTIC = (
    _KNN + ", near AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS base_rank FROM knn QUALIFY base_rank <= {k}), based AS (SELECT *, (1 - distance / max(distance) OVER ()) * 10 AS base FROM near), "
    "scs AS (SELECT *, floor(base * (1 + " + _deltas("0.5", "0.2") + ") * 100 + 0.5::DOUBLE) / 100 AS score FROM based JOIN chunks USING (id)), sem AS (SELECT *, row_number() OVER (ORDER BY score DESC, base_rank) AS rank FROM scs)"
)


@query(CHUNKS + ", " + _SEMANTIC.format(k=20) + " SELECT id, score, CAST(rank AS INTEGER) AS rank FROM sem WHERE rank <= 10")
def i09_semantic_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return search.semantic(_asked_vectors(spark, folder), _vectors(spark, folder), chunks(spark, folder), now(), 10).select("id", F.col("score").cast("double").alias("score"), "rank")


_FUSED = (
    _LEXICAL + ", " + _SEMANTIC.format(k=40) + ", b AS (SELECT 0 AS batch_no, 'fts' AS kind, rank, id, source_file, chunk_text FROM lex WHERE rank <= 10 UNION ALL SELECT 1, 'semantic', rank, id, source_file, chunk_text FROM sem WHERE rank <= 20), "
    "g AS (SELECT source_file, left(chunk_text, 50) AS start, arg_min(id, batch_no * 1000 + rank) AS id, min(batch_no * 1000 + rank) AS seen, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(DISTINCT kind) AS kinds, min(kind) AS kind FROM b GROUP BY 1, 2), "
    "o AS (SELECT id, floor(rrf * 1000 * 100 + 0.5::DOUBLE) / 100 AS score, CASE WHEN kinds > 1 THEN 'hybrid' ELSE kind END AS match_type, row_number() OVER (ORDER BY round(rrf, 12) DESC, seen) AS rank FROM g)"
)


@query(_FUSED + " SELECT id, score, match_type, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 15")
def i12_hybrid_fused(spark: SparkSession, folder: str) -> DataFrame:
    out = search.hybrid(_asked(spark, _PAIR), _asked_vectors(spark, folder), _vectors(spark, folder), chunks(spark, folder), now(), 5, dedupe=False, **_indexed(spark, folder))
    return out.select("id", F.col("score").cast("double").alias("score"), "match_type", "rank")


_WORDINGS = {"no para": ("no", "para"), "que la": ("que", "la"), "los que": ("los", "que")}


def _lexical_of(words: tuple[str, str], n: int) -> str:
    """The SQL of one wording's lexical batch, its tables numbered."""
    own = _LEXICAL.split("tf AS (", 1)[1].replace("'no', 'para'", f"'{words[0]}', '{words[1]}'")
    for name in ("tf", "df", "bm", "top", "sc", "lex"):
        own = re.sub(rf"\b{name}\b(?=\.| AS \(| JOIN|\)|,| GROUP| WHERE| USING)", f"{name}{n}", own)
    kept = re.sub(r"\bdl AS \(.*?FROM dl\), ", "", own)
    return f"tf{n} AS (" + (own if n == 0 else kept)


@query(
    _LEXICAL.split("tf AS (", 1)[0] + ", ".join(_lexical_of(w, n) for n, w in enumerate(_WORDINGS.values())) + ", " + _SEMANTIC.format(k=40) + ", b AS ("
    + "".join(f"SELECT {n} AS batch_no, 'fts' AS kind, rank, id, source_file, chunk_text FROM lex{n} WHERE rank <= 10 UNION ALL " for n in range(len(_WORDINGS)))
    + "SELECT 16, 'semantic', rank, id, source_file, chunk_text FROM sem WHERE rank <= 20), g AS ("
    + _FUSED.split(", g AS (", 1)[1]
    + " SELECT id, score, match_type, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 15"
)
def i12_hybrid_variants(spark: SparkSession, folder: str) -> DataFrame:
    """A query and two rewordings of it, fused with the vectors' batch."""
    wordings = [(0, n, q) for n, q in enumerate(_WORDINGS)]
    variants = spark.createDataFrame(wordings, "query_id long, batch_no int, query string")
    out = search.hybrid(_asked(spark, _PAIR), _asked_vectors(spark, folder), _vectors(spark, folder), chunks(spark, folder), now(), 5, dedupe=False, variants=variants, **_indexed(spark, folder))
    return out.select("id", F.col("score").cast("double").alias("score"), "match_type", "rank")


@query()
def i13_hybrid_thinned(spark: SparkSession, folder: str) -> DataFrame:
    out = search.hybrid(_asked(spark, _PAIR, "que la"), _asked_vectors(spark, folder), _vectors(spark, folder), chunks(spark, folder), now(), 5, **_indexed(spark, folder))
    return out.select("query_id", "id", "score", "match_type", "rank")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select((F.col("id") % 5).alias("query_id"), "id", "source_file", "chunk_type", F.expr("CAST(row_number() OVER (PARTITION BY id % 5 ORDER BY importance DESC NULLS LAST, id) AS INT)").alias("rank"))


_RANKED = CHUNKS + ", r AS (SELECT id % 5 AS query_id, id, source_file, chunk_type, CAST(row_number() OVER (PARTITION BY id % 5 ORDER BY importance DESC NULLS LAST, id) AS INTEGER) AS rank FROM chunks)"


@query(_RANKED + " SELECT query_id, id, rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) <= 2")
def e02_file_cap(spark: SparkSession, folder: str) -> DataFrame:
    return search.cap_by_file(_ranked(spark, folder), 2).select("query_id", "id", "rank")


@query(_RANKED + ", c AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_type ORDER BY rank) > 6 AS bench FROM r) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bench, rank) AS INTEGER) AS place FROM c QUALIFY place <= 10")
def e03_type_cap(spark: SparkSession, folder: str) -> DataFrame:
    return search.cap_by_type(_ranked(spark, folder), 10).select("query_id", "id", "place")


@query(_RANKED + ", s AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INTEGER) AS rank FROM r), a AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT * FROM s WHERE rank <= 10) SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (WHERE a.rank IS DISTINCT FROM b.rank) AS position_changes, round(sum(coalesce(abs(a.rank - b.rank), 10)) / CAST(count(*) * 10 AS DOUBLE), 6) AS mean_shift FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY 1")
def e06_rank_changes(spark: SparkSession, folder: str) -> DataFrame:
    r = _ranked(spark, folder)
    s = r.select("query_id", "id", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT)").alias("rank"))
    return search.rank_changes(r.filter("rank <= 10"), s.filter("rank <= 10"), 10)


@query("WITH q AS (SELECT doc_id AS query_id, lower('trade of asia with Europe: ' || text) AS q FROM documents) SELECT query_id, CAST((SELECT count(*) FROM region WHERE contains(q, lower(r_name))) AS INTEGER) AS entities FROM q")
def i10_entity_count(spark: SparkSession, folder: str) -> DataFrame:
    names = [r.r_name for r in table(spark, folder, "region").collect()]  # a dictionary of five names
    asked = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("trade of asia with Europe: "), "text").alias("query"))
    return search.entity_count(asked, names)


@query(
    _RANKED.replace("id, source_file, chunk_type, CAST(", "id, source_file, chunk_type, source_date AS day, CAST(")
    + ", q AS (SELECT * FROM (VALUES (0, DATE '2025-12-24', 1.0::DOUBLE, true), (1, DATE '2025-03-16', 0.8::DOUBLE, true), (2, NULL, 0.3::DOUBLE, true), (3, DATE '2025-06-30', 0.5::DOUBLE, true), (4, NULL, 0.3::DOUBLE, false)) t(query_id, anchor, trust, dated)), "
    "t AS (SELECT r.*, round(10 / CAST(rank AS DOUBLE), 6) AS score, trust, dated, anchor FROM r JOIN q USING (query_id) WHERE rank <= 20), "
    "m AS (SELECT query_id, list_sort(list(day) FILTER (WHERE rank <= 5 AND day IS NOT NULL)) AS ds, max(score) FILTER (WHERE rank = 1) AS best FROM t GROUP BY 1), "
    "a AS (SELECT t.* EXCLUDE (anchor), best, CAST(coalesce(anchor, CASE WHEN dated AND len(ds) >= 2 THEN ds[len(ds) // 2 + 1] END) AS DATE) AS anchor FROM t JOIN m USING (query_id)), "
    "n AS (SELECT *, 0.5::DOUBLE * exp(-pow(CAST(date_diff('day', anchor, day) AS DOUBLE), 2) / (2 * 30.0::DOUBLE * 30.0::DOUBLE)) AS near FROM a), "
    "s AS (SELECT query_id, id, rank, round(score + CASE WHEN rank = 1 OR near IS NULL THEN 0 ELSE least(2 * near, 1.0::DOUBLE) * greatest(best - score, 0.1::DOUBLE) * trust END, 6) AS new_score FROM n) "
    "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS INTEGER) AS new_rank, new_score FROM s"
)
def i14_temporal_rerank(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ranked(spark, folder).join(chunks(spark, folder).select("id", F.col("source_date").alias("day")), "id").withColumn("score", F.round(10 / F.col("rank"), 6))
    asked = spark.createDataFrame([(0, "what happened on 2025-12-24"), (1, "in march 2025"), (2, "when was it"), (3, "in 2025"), (4, "words")], "query_id long, query string")
    return search.temporal_rerank(rows, asked, now()).select("query_id", "id", "new_rank", "new_score")


_STORES = (
    _BM25.split(", dl AS (")[0].replace("SELECT id, concat(", "SELECT id, agent, concat(").replace("(SELECT id, unnest(t) AS token", "(SELECT id, agent, unnest(t) AS token").replace("UNION ALL SELECT id, unnest(f)", "UNION ALL SELECT id, agent, unnest(f)").replace("UNION ALL SELECT id, unnest(k)", "UNION ALL SELECT id, agent, unnest(k)").replace("SELECT id, token, sum(wt)", "SELECT id, agent, token, sum(wt)").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
    + ", dl AS (SELECT id, agent, len(t) + len(f) + len(k) AS dl FROM w), st AS (SELECT agent, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1), df AS (SELECT agent, token, count(*) AS df FROM tf GROUP BY 1, 2), "
    "bm AS (SELECT tf.agent, tf.id, sum(greatest(CAST(1e-6 AS DOUBLE), ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25, count(*) AS met FROM tf JOIN df USING (agent, token) JOIN dl USING (agent, id) JOIN st USING (agent) GROUP BY 1, 2), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY round(bm25, 9) DESC, id) AS br FROM bm WHERE met = 2 QUALIFY br <= 5), "
    "u AS (SELECT top.agent, top.id, round(bm25, 6) AS score FROM top JOIN chunks USING (id) QUALIFY row_number() OVER (PARTITION BY left(chunk_text, 100) ORDER BY round(bm25, 6) DESC, top.agent, top.id) = 1)"
)


@query(_STORES + " SELECT agent, id, score, CAST(row_number() OVER (ORDER BY score DESC, agent, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 5")
def i17_across_stores(spark: SparkSession, folder: str) -> DataFrame:
    return search.across_stores(_asked(spark, _PAIR), chunks(spark, folder), "agent", 5, **_indexed(spark, folder, ["agent"])).drop("query_id")


_WORD = r"list_filter(regexp_split_to_array(lower(chunk_text), '\s+'), lambda t: length(t) > 3)"


@query(
    CHUNKS + f", a AS (SELECT id, list_distinct(({_WORD})[1:8]) AS ws FROM chunks), p AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM a WHERE len(ws) >= 3), h AS (SELECT id AS match_id, unnest(list_distinct({_WORD})) AS w FROM chunks), "
    "m AS (SELECT id, match_id, round(count(*) / CAST(n AS DOUBLE), 6) AS overlap FROM p JOIN h USING (w) WHERE id <> match_id GROUP BY id, match_id, n) SELECT id, match_id, overlap FROM m WHERE overlap > 0.7 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, match_id) = 1"
)
def i18_word_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The fallback for rows without a vector, of every row."""
    c = chunks(spark, folder)
    return lifecycle.near_copies(c, c)


@query()
def i18_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every row, by cosine with its best lexical hits where it has a vector."""
    c = chunks(spark, folder)
    return lifecycle.near_copies(c, c, vectors=_vectors(spark, folder))


@query(
    CHUNKS + ", n AS (SELECT v.vec_id AS id, v.embedding, v.label, c.created_at, c.source_file FROM embeddings v JOIN chunks c ON c.id = v.vec_id), f AS (SELECT * FROM n WHERE created_at >= DATE '2024-11-01'), "
    "p AS (SELECT f.id AS new_id, n.id AS old_id, f.source_file AS new_file, n.source_file AS old_file, n.created_at, 1 - list_sum(list_transform(list_zip(CAST(n.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2 AS sim FROM f JOIN n ON n.id <> f.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(sim, 9) DESC, old_id) AS r FROM p QUALIFY r <= 6) SELECT new_id, old_id, new_file, old_file, round(sim, 6) AS similarity, sim >= 0.995 AS exact FROM r WHERE created_at < DATE '2024-11-01' AND sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY r) = 1"
)
def c10_churn(spark: SparkSession, folder: str) -> DataFrame:
    return search.churn(chunks(spark, folder), _vectors(spark, folder), F.lit("2024-11-01").cast("date"), 5, 0.3)


@query(_RANKED.replace("AS rank FROM chunks)", "AS rank, left(chunk_text, 100) AS start FROM chunks)") + " SELECT query_id, count(DISTINCT start) AS texts FROM r GROUP BY 1")
def g02_union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).select((F.col("id") % 5).alias("query_id"), F.substring("chunk_text", 1, 100).alias("start"), "id")
    both = c.filter("id % 2 = 0").unionByName(c.filter("id % 2 = 1"))
    return both.dropDuplicates(["query_id", "start"]).groupBy("query_id").agg(F.count("*").alias("texts"))


@query(CHUNKS + ", a AS (SELECT id FROM chunks ORDER BY importance DESC NULLS LAST, id LIMIT 50), b AS (SELECT id FROM chunks ORDER BY pain DESC NULLS LAST, id LIMIT 50) SELECT id, 'would_enter' AS change FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'would_leave' FROM b WHERE id NOT IN (SELECT id FROM a)")
def g03_differences(spark: SparkSession, folder: str) -> DataFrame:
    from engramix.operators import brief

    c = chunks(spark, folder)
    top = lambda k: c.orderBy(F.col(k).desc_nulls_last(), "id").limit(50)
    return brief.differences(top("importance"), top("pain"))


_TAIL = "[a-zA-Z0-9_-]"
# the other engine has no look-ahead: keys that don't begin with ant-
_NOT_ANT = rf"\bsk-(?:[b-zA-Z0-9_-]{_TAIL}{{19,}}|a[a-mo-zA-Z0-9_-]{_TAIL}{{18,}}|an[a-su-zA-Z0-9_-]{_TAIL}{{17,}}|ant[a-zA-Z0-9_]{_TAIL}{{16,}})\b"
_VALID = "(list_sum([CASE WHEN (16 - i + 1) % 2 = 0 THEN CASE WHEN CAST(d[i] AS INTEGER) * 2 > 9 THEN CAST(d[i] AS INTEGER) * 2 - 9 ELSE CAST(d[i] AS INTEGER) * 2 END ELSE CAST(d[i] AS INTEGER) END for i in range(1, 17)]) % 10 = 0)"


def _redaction_steps() -> str:
    """A CTE for each kind of secret, each over the text that the one before has left."""
    out = "WITH s0 AS (SELECT doc_id, text AS t, 0 AS n, CAST([] AS VARCHAR[]) AS kinds FROM documents)"
    for i, (kind, pattern) in enumerate(vocab.SECRETS):
        pattern = (_NOT_ANT if kind == "openai-key" else pattern).replace("'", "''")
        told = "Authorization: [REDACTED:auth-header]" if kind == "auth-header" else f"[REDACTED:{kind}]"
        out += f", c{i} AS (SELECT *, len(regexp_extract_all(t, '{pattern}')) AS m FROM s{i}), s{i + 1} AS (SELECT doc_id, CASE WHEN m > 0 THEN regexp_replace(t, '{pattern}', '{told}', 'g') ELSE t END AS t, n + m AS n, CASE WHEN m > 0 THEN list_append(kinds, '{kind}') ELSE kinds END AS kinds FROM c{i})"
    last = len(vocab.SECRETS)
    out += f", found AS (SELECT *, [{{'t': m, 'n': 0::BIGINT}} for m in list_distinct(regexp_extract_all(t, '{vocab.CARD}'))] AS ms FROM s{last})"
    out += r", digits AS (SELECT doc_id, t, n, kinds, unnest(ms) AS m FROM found WHERE len(ms) > 0), good AS (SELECT doc_id, list(m) AS ms FROM (SELECT *, string_split(regexp_replace(m.t, '[-\s]', '', 'g'), '') AS d FROM digits) WHERE " + _VALID + " GROUP BY 1), "
    out += r"cards AS (SELECT s.doc_id, s.n, s.kinds, CASE WHEN ms IS NULL THEN {'t': s.t, 'n': 0::BIGINT} ELSE list_reduce(list_prepend({'t': s.t, 'n': 0::BIGINT}, ms), lambda a, x: {'t': regexp_replace(a.t, '\b' || x.t || '\b', '[REDACTED:credit-card]', 'g'), 'n': a.n + len(regexp_extract_all(a.t, '\b' || x.t || '\b'))}) END AS r FROM s" + str(last) + " s LEFT JOIN good USING (doc_id))"
    return out


@query(_redaction_steps() + " SELECT doc_id, md5(r.t) AS digest, CAST(n + r.n AS BIGINT) AS count, array_to_string(CASE WHEN r.n > 0 THEN list_append(kinds, 'credit-card') ELSE kinds END, ',') AS kinds FROM cards")
def m01_redacted(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", text.redacted(F.col("text")).alias("r"))
    return docs.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"), "r.count", F.array_join("r.kinds", ",").alias("kinds"))


_DIGITS = "[CAST(d AS INTEGER) for d in string_split(n, '')]"


@query(
    "WITH n AS (SELECT o_orderkey, CAST(4000000000000000 + o_orderkey * 7919 + o_custkey AS VARCHAR) AS n FROM orders), d AS (SELECT o_orderkey, " + _DIGITS + " AS d FROM n), "
    "v AS (SELECT o_orderkey, list_sum([CASE WHEN (len(d) - i + 1) % 2 = 0 THEN CASE WHEN d[i] * 2 > 9 THEN d[i] * 2 - 9 ELSE d[i] * 2 END ELSE d[i] END for i in range(1, len(d) + 1)]) AS s FROM d) SELECT o_orderkey, s % 10 = 0 AS valid FROM v"
)
def m02_luhn(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", text.luhn((4000000000000000 + F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string")).alias("valid"))


@query("WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ok entendi, certo' WHEN 1 THEN '12345678901234' WHEN 2 THEN text ELSE 'thank you done' END AS t FROM conversations) SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN length(trim(t)) <= 10 ELSE true END AS noise FROM c")
def k06_noise(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").selectExpr("conv_id", "turn", "CASE turn % 4 WHEN 0 THEN 'ok entendi, certo' WHEN 1 THEN '12345678901234' WHEN 2 THEN text ELSE 'thank you done' END AS t")
    return c.select("conv_id", "turn", text.is_noise(F.col("t")).alias("noise"))
