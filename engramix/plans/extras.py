"""Further queries: reports, extraction, small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import schemas, vocab
from engramix.functions import chunkers, score, text
from engramix.operators import answers, extract, graph, lifecycle, reports, scan, search, telemetry
from engramix.plans.analytics import _RUNS, _runs
from engramix.plans.registry import ORACLES, query
from engramix.plans.retrieval import _vectors
from engramix.plans.views import AS_OF, CHUNKS, GRAPH, chunks, now, split_columns, table
from engramix.plans.views import graph as graph_of
from engramix.sources import files
from engramix.storage import dealt
from engramix.vocab import case_sql


@query("SELECT doc_id AS id, 'peripheral' AS tier, CAST(0.5 AS DOUBLE) AS importance, CASE WHEN doc_id % 4 = 0 THEN 'external' WHEN doc_id % 7 = 0 THEN 'user_statement' END AS source_type FROM documents")
def a02_migrated(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "documents").selectExpr("doc_id AS id", "text AS chunk_text", "CASE WHEN doc_id % 4 = 0 THEN 'graph:n1' ELSE source END AS source_file", "CASE WHEN doc_id % 7 = 0 THEN 'feedback' ELSE 'other' END AS chunk_type")
    return schemas.source_type_of(schemas.migrated(old, "chunks")).select("id", "tier", "importance", "source_type")


@query("SELECT doc_id AS id, 'user:' AS first, CAST(64 AS INTEGER) AS dim FROM documents")
def a17_embedded(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "documents").selectExpr("doc_id AS id", "text AS chunk_text")
    return files.embedded(own, files.hashed_embedding(64), 64).select("id", F.lit("user:").alias("first"), F.size("embedding").alias("dim"))


@query("SELECT count(*) AS searches, count(*) FILTER (WHERE results_count = 0) AS empty FROM (SELECT conv_id, count(*) FILTER (WHERE turn > 0) AS results_count FROM conversations GROUP BY 1)")
def o01_search_log(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    queries = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.min("text").alias("query"))
    log = search.search_log(queries, c.filter("turn > 0").select(F.col("conv_id").alias("query_id")), now(), 1.0, False)
    return log.agg(F.count("*").alias("searches"), F.count_if(F.col("results_count") == 0).alias("empty"))


@query("WITH c AS (" + ORACLES["c10_churn"] + ") SELECT new_file, old_file, exact, count(*) AS n, min(new_id) AS first_new_id FROM c GROUP BY ALL")
def k12_churn_report(spark: SparkSession, folder: str) -> DataFrame:
    return search.churn_report(search.churn(chunks(spark, folder), _vectors(spark, folder), F.lit("2024-11-01").cast("date"), 5, 0.3))


@query("WITH c AS (SELECT user_id AS query_hash, count(*) AS hit_count FROM events GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY hit_count DESC, query_hash) AS INTEGER) AS place, query_hash, hit_count AS hits, (SELECT count(*) FROM c) AS entries, (SELECT CAST(sum(hit_count) AS BIGINT) FROM c) AS total_hits FROM c QUALIFY place <= 5")
def d20_cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    return answers.cache_stats(table(spark, folder, "events").groupBy(F.col("user_id").alias("query_hash")).agg(F.count("*").alias("hit_count")))


@query(GRAPH + " SELECT id, name, mention_count FROM entities ORDER BY mention_count DESC, id LIMIT 200")
def f05_top_entities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.top_entities(graph_of(spark, folder)[0]).select("id", "name", "mention_count")


@query(GRAPH + ", o AS (SELECT id, name, mention_count FROM entities WHERE lower(name) = 'red widget' ORDER BY mention_count DESC, id DESC LIMIT 6) SELECT CAST(row_number() OVER (ORDER BY mention_count DESC, id DESC) AS INTEGER) AS place, id, name FROM o")
def f06_newest_named(spark: SparkSession, folder: str) -> DataFrame:
    return graph.newest_named(graph_of(spark, folder)[0], "Red Widget")


@query("WITH r AS (SELECT DISTINCT doc_id AS id, 'mentions' AS relation_type, source AS target FROM documents WHERE doc_id % 2 = 0), m AS (SELECT doc_id AS id, 'mentions' AS relation_type, source AS target FROM documents WHERE doc_id % 3 = 0) SELECT id, relation_type, target, CASE WHEN id % 2 = 0 THEN 'wikilink' ELSE 'llm' END AS method FROM (SELECT * FROM r UNION SELECT * FROM m)")
def g05_combined_relations(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").selectExpr("doc_id AS id", "'mentions' AS relation_type", "source AS target")
    rules = d.filter("id % 2 = 0").withColumns({"method": F.lit("wikilink"), "confidence": F.lit(0.9)})
    return extract.combined(rules, d.filter("id % 3 = 0")).select("id", "relation_type", "target", "method")


@query(
    "SELECT doc_id, 'is_agent_of' AS relation, source AS target FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, 'references', unnest(CASE doc_id % 4 WHEN 0 THEN [lang, 'b' || doc_id] WHEN 1 THEN ['x ' || lang] ELSE [source, lang] END) FROM documents WHERE doc_id % 4 <> 3"
)
def h10_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    """Scalars, lists in one line, lists of lines, and files whose block isn't at their beginning."""
    chunkers.register(spark)
    fields = "CASE doc_id % 4 WHEN 0 THEN concat('agent: ', source, '\\nreferences: [', lang, ', \"b', doc_id, '\"]') WHEN 1 THEN concat('agent: \"', source, '\"\\nreferences: x ', lang) ELSE concat('references:\\n  - ', source, '\\n  - ', lang, '\\nagent: ', source) END"
    d = table(spark, folder, "documents").select("doc_id", F.expr(f"concat(CASE WHEN doc_id % 4 = 3 THEN 'text before\\n' ELSE '' END, '---\\n', {fields}, '\\n---\\n', text)").alias("t"))
    return spark.sql("SELECT d.doc_id, f.relation, f.target FROM {d} d, LATERAL frontmatter_relations(d.t) f", d=d)


@query()
def h11_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", extract.anchors(F.concat("text", F.lit(" erro no banco v1.2.3 MAX_SIZE"))).alias("anchors"))


@query(f"SELECT o_orderkey, round(CAST(0.5 AS DOUBLE) * exp(-pow(CAST(date_diff('day', DATE '1996-06-01', CAST(o_orderdate AS DATE)) AS DOUBLE), 2) / (2 * 900 * CAST(100 AS DOUBLE))), 6) AS near FROM orders")
def h13_proximity(spark: SparkSession, folder: str) -> DataFrame:
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")).cast("double")
    return table(spark, folder, "orders").select("o_orderkey", F.round(0.5 * F.exp(-F.pow(days, 2.0) / (2 * 900 * 100.0)), 6).alias("near"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('{\"k\":', json_extract_string(props, '$.k'), ',\"n\":{\"x\":[1,true,null]},\"s\":\"u', user_id, '\"}') WHEN 1 THEN concat('{\"s\":\"', event_type, '\",\"k\":', json_extract_string(props, '$.k'), ',\"n\":{\"y\":1.5}}') ELSE concat('{\"s\":\"', event_type, '\",\"k\":', json_extract_string(props, '$.k'), ',\"n\":{\"x\":[1,true,null]}}') END AS m FROM events")
def h21_merged_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Old attributes (a type, a number, an object) with new ones: another type, another object, or none."""
    k = F.get_json_object("props", "$.k")
    old = F.concat(F.lit('{"s":"'), "event_type", F.lit('","k":'), k, F.lit(',"n":{"x":[1,true,null]}}'))
    new = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"s":"u'), "user_id", F.lit('"}'))).when(F.col("event_id") % 3 == 1, '{"n":{"y":1.5}}').otherwise("{}")
    return table(spark, folder, "events").select("event_id", extract.merged_attributes(old, new).alias("m"))


@query(CHUNKS + f" SELECT id, {case_sql('section', {k: round(v - 1, 6) for k, v in vocab.SECTION_FACTOR_TEMPORAL.items()}, None)} AS temporal, {case_sql('section', {k: round(v - 1, 6) for k, v in vocab.SECTION_FACTOR.items()}, None)} AS plain FROM chunks WHERE section IS NOT NULL")
def i15_section_deltas(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).filter("section is not null")
    delta = lambda f: F.round(score.section_delta(F.col("section"), F.col("section_boost"), f), 6)
    return c.select("id", delta(vocab.SECTION_FACTOR_TEMPORAL).alias("temporal"), delta(vocab.SECTION_FACTOR).alias("plain"))


@query(CHUNKS + ", t AS (SELECT id // 50 AS query_id, id, length(chunk_text) AS l, row_number() OVER (PARTITION BY id // 50 ORDER BY id) AS rank FROM chunks), k AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l DESC, rank) AS INTEGER) AS new_rank FROM t WHERE rank <= 50) SELECT query_id, id, new_rank FROM k WHERE new_rank <= 10")
def i16_reranked(spark: SparkSession, folder: str) -> DataFrame:
    # a query for every 50 ids, so that each row of the table is among those that are scored
    rows = chunks(spark, folder).selectExpr("CAST(floor(id / 50) AS BIGINT) AS query_id", "'x' AS query", "id", "chunk_text", "CAST(row_number() OVER (PARTITION BY floor(id / 50) ORDER BY id) AS INT) AS rank")
    return search.rerank(rows, lambda q, t: [len(x) for x in t]).select("query_id", "id", "new_rank")


@query(CHUNKS + f", o AS (SELECT id, '[' || chunk_type || '] ' || chunk_text AS line FROM chunks WHERE chunk_type IN ('decision', 'lesson', 'person', 'project', 'pending', 'daily') AND source_date >= DATE '{AS_OF}' - 7) SELECT '2026-W03' AS week, id, md5(line) AS digest FROM o")
def k08_digest(spark: SparkSession, folder: str) -> DataFrame:
    return reports.digest_rows(chunks(spark, folder), now()).select("week", "id", F.md5(F.col("line").cast("binary")).alias("digest"))


_ONE_LINE = r"(SELECT CASE WHEN length(t) > 140 THEN left(t, 139) || '…' ELSE t END FROM (SELECT coalesce(list_filter([trim(replace(regexp_replace(regexp_replace(x, '^#{{1,6}}\s+', ''), '^[-*>]\s+', ''), '**', '')) for x in [trim(regexp_replace(regexp_replace(y, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) for y in string_split({}, chr(10))] if x <> '' AND x <> '---' AND x <> '```'], lambda x: x <> '')[1], '') AS t))"


_TOLD = "concat(CASE id % 3 WHEN 0 THEN concat('- **Choice ', CAST(id AS VARCHAR(20)), '** is made') WHEN 1 THEN concat('intro\n', '**Decisão:** number ', CAST(id % 7 AS VARCHAR(20))) ELSE '' END, chr(10), chunk_text)"


@query(
    CHUNKS + f", c AS (SELECT *, {_TOLD} AS told FROM chunks)".replace("\n", "' || chr(10) || '") + ", "
    "d AS (SELECT id, CASE id % 3 WHEN 0 THEN left('- **Choice ' || id || '** is made', 120) WHEN 1 THEN '- **Decisão:** number ' || id % 7 END AS line FROM (SELECT * FROM c WHERE chunk_type = 'decision' ORDER BY id DESC LIMIT 15)), "
    "e AS (SELECT 'decisions' AS section, line, max(id) AS id FROM d WHERE line IS NOT NULL GROUP BY line ORDER BY id DESC LIMIT 5), "
    "t AS (SELECT 'today' AS section, " + _ONE_LINE.format("told") + " AS line, id FROM c WHERE source_date = DATE '2026-01-10' ORDER BY id DESC LIMIT 3), "
    "p AS (SELECT 'pending' AS section, " + _ONE_LINE.format("told") + " AS line, id FROM c WHERE chunk_type = 'pending' ORDER BY id DESC LIMIT 3), "
    "u AS (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM p) SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY id DESC) AS INTEGER) AS place, line FROM u"
)
def k08_primer(spark: SparkSession, folder: str) -> DataFrame:
    told = chunks(spark, folder).withColumn("chunk_text", F.expr(_TOLD.replace("\n", "\\n")))
    return reports.primer(told, F.lit("2026-01-10").cast("timestamp"))


@query(CHUNKS + " SELECT chunk_type, " + case_sql("chunk_type", vocab.RETENTION_DAYS, vocab.RETENTION_FALLBACK) + " AS days FROM chunks GROUP BY chunk_type")
def k03_retention_table(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_type").distinct().select("chunk_type", lifecycle.default_retention(F.col("chunk_type")).cast("double").alias("days"))


@query(CHUNKS + " SELECT agent, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 50")
def k11_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return reports.strengths(chunks(spark, folder))


@query(CHUNKS + " SELECT sha256(chunk_text) AS fp, min(id) AS kept_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1")
def i18_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.exact_copies(chunks(spark, folder))


@query(
    GRAPH + ", " + CHUNKS.removeprefix("WITH ") + ", e AS (SELECT 'entities' AS section, name, mention_count AS n FROM entities ORDER BY mention_count DESC, id LIMIT 20), "
    r"p AS (SELECT 'projects' AS section, regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\.md$', '') AS name, count(*) AS n FROM chunks WHERE chunk_type = 'project' AND source_date >= DATE '" + AS_OF + "' - 30 GROUP BY 2), "
    "d AS (SELECT 'decisions' AS section, " + _ONE_LINE.format("chunk_text") + f" AS name, CAST(1 AS BIGINT) AS n FROM chunks WHERE chunk_type = 'decision' AND source_date >= DATE '{AS_OF}' - 30) "
    "SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM d"
)
def j12_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reports.profile(graph_of(spark, folder)[0], chunks(spark, folder), now())


@query(CHUNKS + " SELECT section, NOT coalesce(section IN ('compiled', 'frontmatter', 'timeline') AND id % 2 = 0, false) AS model, count(*) AS n FROM chunks GROUP BY ALL")
def j13_extraction_gate(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).withColumn("chunk_text", F.concat(F.when(F.col("id") % 2 == 0, "see [[projects/p1]] ").otherwise(""), "chunk_text"))
    return extract.needs_model(c, extract.by_rule(c)).groupBy("section", "model").agg(F.count("*").alias("n"))


@query(
    CHUNKS + ", v AS (SELECT count(*) AS n, count(v.vec_id) AS v FROM chunks LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = id), d AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS good, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS bad FROM orders) "
    "SELECT 'vectors' AS \"check\", n = v AS ok, v || ' of ' || n AS detail FROM v UNION ALL SELECT 'consolidation', bad = 0, good || ' done, ' || bad || ' failed' FROM d"
)
def o06_doctor(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "orders").selectExpr("CAST(o_orderkey AS STRING) AS source_file", "CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN -1 ELSE 0 END AS status")
    return reports.doctor(chunks(spark, folder), _vectors(spark, folder), done)


@query("WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS ops, user_id % 100 / CAST(100 AS DOUBLE) AS coverage FROM events GROUP BY 1) SELECT user_id, CASE WHEN coverage >= 0.95 THEN 'ok' WHEN coverage >= 0.8 THEN 'warn' ELSE 'critical' END AS vector_level, CASE WHEN failed / CAST(ops AS DOUBLE) < 0.05 THEN 'ok' WHEN failed / CAST(ops AS DOUBLE) < 0.2 THEN 'warn' ELSE 'critical' END AS ops_level FROM n")
def o03_health(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("ops")).withColumns({"coverage": F.col("user_id") % 100 / 100, "canary_ok": F.lit(True)})
    return telemetry.health(n).select("user_id", "vector_level", "ops_level")


@query(_RUNS + " SELECT command, count(*) FILTER (WHERE status = 'success') AS good, count(*) FILTER (WHERE status <> 'success') AS bad, round(sum(CASE WHEN status = 'success' THEN duration_ms END), 2) AS good_sum FROM runs GROUP BY ALL")
def b06_conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    return scan.outcomes(_runs(spark, folder), ["command"], "status", "duration_ms")


@query(
    r"WITH c AS (SELECT c_custkey, concat('old-one, x-old-one and old-one-x; ', CASE WHEN c_custkey % 3 = 0 THEN 'see (old-one) ' ELSE '' END, c_name, ' OLD-ONE old-one') AS t FROM customer) "
    r"SELECT c_custkey, regexp_replace(regexp_replace(t, '(^|[^a-z0-9_-])old-one($|[^a-z0-9_-])', '\1the-new\2', 'g'), '(^|[^a-z0-9_-])old-one($|[^a-z0-9_-])', '\1the-new\2', 'g') AS t FROM c"
)
def j14_renamed(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").selectExpr("c_custkey", "concat('old-one, x-old-one and old-one-x; ', CASE WHEN c_custkey % 3 = 0 THEN 'see (old-one) ' ELSE '' END, c_name, ' OLD-ONE old-one') AS chunk_text")
    return graph.renamed(c, "old-one", "the-new").withColumnRenamed("chunk_text", "t")


_CHAINS = "p_partkey AS k, CASE WHEN CAST(floor(p_partkey / 40) AS BIGINT) % 2 = 0 THEN CAST(floor(p_partkey / 40) AS BIGINT) * 40 + (p_partkey + 1) % 40 ELSE p_partkey + 1 END AS next"


@query(
    f"WITH RECURSIVE c AS (SELECT {_CHAINS} FROM part), w AS (SELECT k AS start, next AS now, 1 AS n FROM c UNION ALL SELECT w.start, c.next, n + 1 FROM w JOIN c ON c.k = w.now WHERE w.now <> w.start AND n < 41) "
    "SELECT concat('p', start) AS start FROM w WHERE now = start"
)
def j14_rename_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts renamed in rings of 40, and in chains that lead into them."""
    c = table(spark, folder, "part").selectExpr(*split_columns(_CHAINS))
    return graph.rename_cycles(c.select(F.concat(F.lit("p"), "k").alias("old"), F.concat(F.lit("p"), "next").alias("new")))


_EVENT_SECRETS = [r"AIza[0-9A-Za-z_-]{30,}", r"AQ\.[0-9A-Za-z_-]{30,}", r"sk-[0-9A-Za-z_-]{20,}", r"ghp_[0-9A-Za-z]{30,}", r"xox[baprs]-[0-9A-Za-z-]{10,}", r"Bearer\s+[0-9A-Za-z._~+/=-]{16,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"]
_TOLD_SECRET = "concat(text, CASE WHEN doc_id % 5 = 0 THEN ' Bearer abcdefghijklmnopqrst' WHEN doc_id % 5 = 1 THEN concat(' sk-', md5(text), ' and ghp_', md5(source)) ELSE '' END)"


def _blanked(first: str, patterns: list[str], by: str) -> str:
    """CTEs that blank one pattern after the other in t and count them in n."""
    out = f"WITH s0 AS (SELECT doc_id, {first} AS t, 0 AS n FROM documents)"
    for i, p in enumerate(patterns):
        out += f", s{i + 1} AS (SELECT doc_id, regexp_replace(t, '{p}', '{by}', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM s{i})"
    return out


@query(_blanked(_TOLD_SECRET, _EVENT_SECRETS, "[REDACTED]") + f" SELECT doc_id, CAST(n AS INTEGER) AS n, md5(t) AS digest FROM s{len(_EVENT_SECRETS)}")
def m03_event_secrets(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", extract.event_secrets(F.expr(_TOLD_SECRET)).alias("s"))
    return d.select("doc_id", F.col("s.count").alias("n"), F.md5(F.col("s.text").cast("binary")).alias("digest"))


_FAILED = "concat('cannot read ', source, CASE doc_id % 4 WHEN 0 THEN ' with Bearer abc.def' WHEN 1 THEN ' of /home/ann/.netrc now' WHEN 2 THEN concat(' key AIza', substring(concat(md5(text), md5(source)), 1, 35)) ELSE ' sk-ant-api03-zz' END)"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'AIza[A-Za-z0-9_-]{{35}}', 'AIza[REDACTED]', 'g'), 'sk-ant-(oat|api)[A-Za-z0-9_-]+', 'sk-ant-\1[REDACTED]', 'g'), 'Bearer\s+[A-Za-z0-9_.-]+', 'Bearer [REDACTED]', 'g'), '/home/[^/\s]+/\.[^\s]+', '/home/[USER]/[REDACTED-DOTFILE]', 'g') AS message FROM (SELECT doc_id, {_FAILED} AS t FROM documents)")
def m03_audit_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", extract.audit_scrubbed(F.expr(_FAILED)).alias("message"))


_ERROR = "CASE doc_id % 5 WHEN 0 THEN 'ValidationError' WHEN 1 THEN 'NotFoundError' WHEN 2 THEN 'TypeError' WHEN 3 THEN 'ConflictError' ELSE 'RetrievalEmptyError' END"
_CAUSE = "CASE doc_id % 3 WHEN 0 THEN concat('bad field ', text) WHEN 1 THEN concat('password=', source, ' is wrong') ELSE concat('no file /etc/', source) END"


def _withheld() -> str:
    """The message without secrets (p) and in one line (line)."""
    p = "m"
    for pattern in (r"AIza[0-9A-Za-z_-]{20,}", r"sk-[A-Za-z0-9]{20,}", r"(?i)Bearer\s+[A-Za-z0-9._-]{20,}", r"(key|token)=[A-Za-z0-9_-]{16,}", r"(?i)(password|passphrase)=[^\s&]+", r"\b[A-Z]{2,}_[A-Z_]+=[^\s]+"):
        p = f"regexp_replace({p}, '{pattern}', '[REDACTED]', 'g')"
    return f"c AS (SELECT *, {p} AS p FROM s), l AS (SELECT *, regexp_replace(p, '[\\r\\n]+', ' ', 'g') AS line FROM c)"


@query(
    f"WITH e AS (SELECT doc_id, {_ERROR} AS kind, {_CAUSE} AS m FROM documents), s AS (SELECT *, CASE kind WHEN 'ValidationError' THEN 400 WHEN 'NotFoundError' THEN 404 WHEN 'ConflictError' THEN 409 WHEN 'RetrievalEmptyError' THEN 503 ELSE 500 END AS status FROM e), "
    + _withheld()
    + " SELECT doc_id, CAST(status AS INTEGER) AS status, CASE kind WHEN 'ValidationError' THEN 'VALIDATION_ERROR' WHEN 'NotFoundError' THEN 'NOT_FOUND' WHEN 'ConflictError' THEN 'CONFLICT' WHEN 'RetrievalEmptyError' THEN 'RETRIEVAL_EMPTY' ELSE 'INTERNAL_ERROR' END AS code, "
    + r"CASE WHEN kind = 'NotFoundError' THEN 'resource not found' WHEN status >= 500 THEN 'internal error' WHEN regexp_matches(p, '/(Users|home|root|var|etc|tmp|opt)/[^\s]+') THEN 'request failed (details redacted)' WHEN length(line) > 200 THEN left(line, 200) || '…' ELSE line END AS error FROM l"
)
def m03_public_errors(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", extract.public_error(F.expr(_ERROR), F.expr(_CAUSE)).alias("e"))
    return d.select("doc_id", "e.status", "e.code", "e.error")


_ABOUT = "concat(text, CASE doc_id % 4 WHEN 0 THEN concat(' quando subiu ', source, '?') WHEN 1 THEN concat(' log of 20', 10 + doc_id % 15, '-01-01') WHEN 2 THEN concat(' whenever ', lang) ELSE '' END)"


@query(r"SELECT doc_id, length(trim(q)) >= 3 AND (regexp_matches(q, '(?i)(^|\s)(" + "|".join(vocab.TEMPORAL_WORDS) + r")(\s|[.,?!]|$)') OR regexp_matches(q, '\b\d{4}-\d{2}-\d{2}\b')) AS temporal FROM (SELECT doc_id, " + _ABOUT + " AS q FROM documents)")
def h12_temporal_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.is_temporal(F.expr(_ABOUT)).alias("temporal"))

