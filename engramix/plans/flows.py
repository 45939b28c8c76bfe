"""Queries over what comes in: routes, files, events, sessions, notes, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import vocab
from engramix.functions import chunkers, score, text
from engramix.operators import brief, extract, graph, reports, search, telemetry
from engramix.plans.extras import _ONE_LINE
from engramix.plans.registry import query
from engramix.plans.retrieval import _RANKED, _SALIENT, _ranked
from engramix.plans.views import AS_OF, CHUNKS, GRAPH, chunks, now, table
from engramix.plans.views import graph as graph_of
from engramix.sources import files
from engramix.streaming import streams
from engramix.vocab import case_sql

# --- files -----------------------------------------------------------------------------------------------------------


@query(CHUNKS + " SELECT least(count(*), 10001) AS chunks, count(*) > 10000 AS blocked FROM chunks")
def a03_store_guard(spark: SparkSession, folder: str) -> DataFrame:
    return files.too_large(chunks(spark, folder))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()) + ") t(name)")
def a04_file_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The tables' names, from a walk over the folder that they are in."""
    found = files.read_tree(spark, folder, "*.parquet").select(F.regexp_extract("source_file", r"([a-z]+)\.parquet", 1).alias("name"))
    return found.filter("name <> ''").distinct()


_PATHS = "CASE doc_id % 5 WHEN 0 THEN concat('memory/entities/persons/', source, '.md') WHEN 1 THEN concat('memory/2024-0', 1 + doc_id % 9, '-11.md') WHEN 2 THEN concat('data/', lang, '.json') WHEN 3 THEN concat('memory/feedback/', source, '.md') ELSE 'memory/decisions.md' END"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'entity' WHEN 2 THEN 'json' ELSE 'markdown' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'entity' END AS forced FROM (SELECT doc_id, {_PATHS} AS path FROM documents)")
def a05_routed(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.expr(_PATHS).alias("path"))
    forced = F.when(F.col("doc_id") % 2 == 0, files.route(F.col("path"), "markdown")).otherwise(files.route(F.col("path"), "entity"))
    return d.select("doc_id", files.route(F.col("path")).alias("kind"), forced.alias("forced"))


@query(
    f"WITH p AS (SELECT DISTINCT doc_id, {_PATHS} AS path FROM documents), t AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'daily' WHEN 2 THEN 'other' WHEN 3 THEN 'feedback' ELSE 'decision' END AS chunk_type FROM p) "
    "SELECT path AS source_file, chunk_type, CASE doc_id % 5 WHEN 0 THEN 'compiled' END AS section, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2})', 1) ELSE '" + AS_OF + "' END AS source_date, "
    f"CAST({case_sql('chunk_type', vocab.RETENTION_DAYS, vocab.RETENTION_FALLBACK)} AS INTEGER) AS retention_days, CASE doc_id % 5 WHEN 0 THEN greatest(0.9, {case_sql('chunk_type', vocab.IMPORTANCE, vocab.IMPORTANCE_FALLBACK)}) ELSE {case_sql('chunk_type', vocab.IMPORTANCE, vocab.IMPORTANCE_FALLBACK)} END AS importance, "
    "CASE doc_id % 5 WHEN 0 THEN 'entity' WHEN 2 THEN 'other' ELSE 'note' END AS source_type, count(*) AS files FROM t GROUP BY ALL"
)
def a06_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """What each file's chunks are marked with; the first chunk of each document stands for it."""
    d = table(spark, folder, "documents").select(F.concat_ws("#", F.expr(_PATHS), F.col("doc_id").cast("string")).alias("key"), F.expr(_PATHS).alias("source_file"), "text")
    rows = files.ingest(d, now()).filter("pos = 0")
    return rows.groupBy("source_file", "chunk_type", "section", F.col("source_date").cast("string").alias("source_date"), "retention_days", "importance", "source_type").agg(F.count("*").alias("files"))


@query(
    "SELECT doc_id, 'frontmatter' AS section, md5('name: ' || source || chr(10) || 'tags: ' || lang || ', b') AS digest FROM documents UNION ALL "
    r"SELECT doc_id, 'compiled', md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) FROM documents WHERE regexp_matches(text, '\S') UNION ALL SELECT doc_id, 'timeline', md5(unnest(['2024-01-0' || (1 + doc_id % 9) || ' began', 'went on in ' || lang])) FROM documents"
)
def a11_entity_sections(spark: SparkSession, folder: str) -> DataFrame:
    chunkers.register(spark)
    page = "concat('---\\nname: ', source, '\\ntags: [', lang, ', b]\\n---\\n', text, '\\n\\n## Timeline\\n- 2024-01-0', 1 + doc_id % 9, ' began\\n* went on in ', lang, '\\n')"
    d = table(spark, folder, "documents").select("doc_id", F.expr(page).alias("t"))
    return spark.sql("SELECT d.doc_id, c.section, md5(c.chunk) AS digest FROM {d} d, LATERAL parse_entity(d.t) c", d=d)


@query(
    "WITH l AS (SELECT n_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS p FROM nation JOIN supplier ON s_nationkey = n_nationkey) "
    "SELECT 'graph:n' || n_nationkey AS source_file, n_name || ' (nation)' || chr(10) || coalesce((SELECT string_agg('- has s' || s_suppkey, chr(10) ORDER BY p) FROM l WHERE l.k = n_nationkey AND p <= 8), '') AS chunk_text FROM nation"
)
def a12_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """An export of nations (25 nodes) with links to their suppliers."""
    nodes = table(spark, folder, "nation").agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"))).alias("nodes"))
    near = F.struct(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"), F.lit("has").alias("relation"))
    links = table(spark, folder, "supplier").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", near.alias("l")))), lambda x: x["l"]).alias("links"))
    return files.graph_chunks(nodes.crossJoin(links)).select("source_file", F.rtrim("chunk_text", F.lit(" ")).alias("chunk_text"))  # one row each


_EVENT = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'session_end' WHEN 1 THEN 'pre_compact' WHEN 2 THEN 'else' ELSE 'pre_compact' END AS kind, 's' || CAST(conv_id AS VARCHAR(20)) AS session_id, text AS content, CASE conv_id % 3 WHEN 0 THEN 'my project!' WHEN 1 THEN 'app' END AS scope, CASE conv_id % 5 WHEN 0 THEN 'Mac' ELSE 'vps' END AS host, CAST(turn AS VARCHAR(20)) AS seq FROM "


@query(
    "WITH e AS (" + _EVENT + "conversations), good AS (SELECT * FROM e WHERE kind <> 'else' AND coalesce(scope, 'app') = 'app' AND host = 'vps' AND trim(coalesce(content, '')) <> '' AND strlen(content) <= 16384), once AS (SELECT DISTINCT kind, session_id, seq, coalesce(scope, 'unscoped') AS scope FROM good) "
    "SELECT 'events/vps/' || scope || '/' || session_id || CASE WHEN seq = '0' THEN '' ELSE '-' || seq END || '.md' AS source_file, CASE kind WHEN 'session_end' THEN '## Session digest' ELSE '## Compaction digest' END || ' — ' || scope || ' (vps, 2026-01-15)' AS head, 90 AS retention_days FROM once WHERE NOT (session_id = 's1' AND kind = 'session_end' AND seq = '0')"
)
def a13_taken_in(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.sql(_EVENT + "{c}", c=table(spark, folder, "conversations"))
    store = spark.createDataFrame([('{"kind": "session_end", "session_id": "s1"}',)], "metadata string")
    out = streams.taken_in(events, store, now())
    return out.select("source_file", F.regexp_extract("chunk_text", r"^([^\n]*)", 1).alias("head"), "retention_days")


@query(
    "WITH c AS (SELECT conv_id, turn, role, regexp_replace(CASE turn % 5 WHEN 3 THEN 'HEARTBEAT ' || text WHEN 4 THEN '[cron:1] ' || text ELSE text END, '^ +| +$', '', 'g') AS t, turn % 5 AS k FROM conversations WHERE text IS NOT NULL) "
    "SELECT 'c' || conv_id AS session_key, turn AS n, role, md5(t) AS digest FROM c WHERE role IN ('user', 'assistant') AND k < 3 AND length(t) >= 5 AND NOT starts_with(t, 'HEARTBEAT') AND NOT starts_with(t, '[cron:') AND NOT starts_with(t, 'The conversation history before this point') AND NOT regexp_matches(t, '^heartbeat[_ ]ok\\b', 'i')"
)
def a14_session_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of three shapes: a message alone, an event with a text, an event with parts."""
    said = F.expr("CASE turn % 5 WHEN 3 THEN concat('HEARTBEAT ', text) WHEN 4 THEN concat('[cron:1] ', text) ELSE text END")
    part = F.array(F.struct(F.lit("text").alias("type"), said.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))
    event = lambda content: F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", content.alias("content")).alias("message")))
    line = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("role", said.alias("content")))).when(F.col("turn") % 3 == 1, event(said)).otherwise(event(part))
    rows = table(spark, folder, "conversations").filter("text is not null").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_key"), F.col("turn").alias("n"), line.alias("line"))
    broken = rows.limit(1).select("session_key", "n", F.lit("not json {").alias("line"))
    return files.messages(rows.unionByName(broken)).select("session_key", "n", "role", F.md5("text").alias("digest"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS version FROM orders ORDER BY 1 DESC LIMIT 5")
def a20_versions_kept(spark: SparkSession, folder: str) -> DataFrame:
    return files.versions_kept(table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("version")).distinct(), 5)


@query("SELECT c_custkey, '# t' || chr(10) || chr(10) || '## A' || chr(10) || 'old ' || c_name || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '- ' || c_mktsegment || chr(10) || chr(10) || '## B' || chr(10) || 'two' || chr(10) ELSE chr(10) || '## B' || chr(10) || 'two' || chr(10) || '- ' || c_mktsegment || chr(10) END AS page FROM customer")
def a21_inserted_lines(spark: SparkSession, folder: str) -> DataFrame:
    page = F.concat(F.lit("# t\n\n## A\nold "), "c_name", F.lit("\n\n## B\ntwo\n"))
    insert = F.udf(files.inserted_under, "string", useArrow=True)
    heading = F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B")
    return table(spark, folder, "customer").select("c_custkey", insert(page, heading, F.concat(F.lit("- "), "c_mktsegment")).alias("page"))


@query("SELECT 'a' AS agent, count(*) AS n, sum(p_partkey) AS keys FROM part UNION ALL SELECT 'c', count(*), sum(p_partkey) FROM part")
def a22_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Two stores, and one that is missing."""
    stores = files.read_stores(spark, {"a": f"{folder}/part.parquet", "b": f"{folder}/missing.parquet", "c": f"{folder}/part.parquet"})
    return stores.groupBy("agent").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id AS source_file, md5(line) AS digest, count(*) AS n FROM l WHERE regexp_matches(line, '[0-9]{3,}|license') GROUP BY ALL")
def a23_matching_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("source_file"), F.explode(F.split("text", "\n")).alias("line"))
    return files.matching(lines, "[0-9]{3,}|license").groupBy("source_file", F.md5("line").alias("digest")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT event_id AS n, 'op ' || event_type || CASE WHEN event_id % 4 = 0 THEN ' OK' WHEN event_id % 4 = 1 THEN ' FAIL: ' || user_id ELSE ' NOTOK' END AS line FROM events) SELECT n, line, nullif(regexp_extract(line, '\\b(OK|FAIL)\\b', 1), '') AS state FROM l ORDER BY n DESC LIMIT 200")
def a24_log_tail(spark: SparkSession, folder: str) -> DataFrame:
    line = "concat('op ', event_type, CASE WHEN event_id % 4 = 0 THEN ' OK' WHEN event_id % 4 = 1 THEN concat(' FAIL: ', user_id) ELSE ' NOTOK' END)"
    return files.tail(table(spark, folder, "events").select(F.col("event_id").alias("n"), F.expr(line).alias("line")))


@query(
    "WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'my app' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_name ELSE '-' || c_name END AS p, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 50) || 'h' WHEN 1 THEN '2w' WHEN 2 THEN 'x' ELSE '10d' END AS since, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 60 - 5 AS VARCHAR) ELSE 'many' END AS n FROM customer) "
    r"SELECT c_custkey, regexp_full_match(p, '[\p{L}\p{N}][\p{L}\p{N}._-]{0,63}') AS scope_ok, regexp_full_match(p, '[a-z0-9][a-z0-9-]{0,31}') AS agent_ok, CASE since WHEN '2w' THEN 336 WHEN '10d' THEN 240 WHEN 'x' THEN NULL ELSE CAST(replace(since, 'h', '') AS INTEGER) END AS hours, CASE WHEN n = 'many' THEN 10 ELSE least(25, greatest(1, TRY_CAST(n AS INTEGER))) END AS n FROM c"
)
def b09_parameters(spark: SparkSession, folder: str) -> DataFrame:
    shapes = ["c_custkey", "CASE c_custkey % 6 WHEN 0 THEN 'my app' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_name ELSE concat('-', c_name) END AS p", "CASE c_custkey % 4 WHEN 0 THEN concat(c_custkey % 50, 'h') WHEN 1 THEN '2w' WHEN 2 THEN 'x' ELSE '10d' END AS since", "CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 60 - 5 AS STRING) ELSE 'many' END AS n"]
    c = table(spark, folder, "customer").selectExpr(*shapes)
    return c.select("c_custkey", text.valid(F.col("p"), vocab.SCOPE).alias("scope_ok"), text.valid(F.col("p"), vocab.AGENT).alias("agent_ok"), text.since_hours(F.col("since")).alias("hours"), text.clamped(F.col("n"), 1, 25, 10).alias("n"))


# --- ranking and graph -----------------------------------------------------------------------------------------------


@query(CHUNKS + f" SELECT id, {case_sql('tier', {k: round(v - 1, 6) for k, v in vocab.TIER_FACTOR.items()}, 0.0)} AS delta FROM chunks")
def i05_tier_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("id", F.round(score.tier_delta(F.col("tier")), 6).alias("delta"))


@query(_SALIENT + " SELECT id, round(salience - 0.5::DOUBLE, 6) AS delta FROM s")
def i06_salience_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """What salience adds to a chunk's boosts: those with it less those without."""
    c = chunks(spark, folder)
    with_, without = (search.boosts(now(), 1.0, 0.5, F.lit(0), salience=on) for on in (True, False))
    return c.select("id", F.round(with_ - without, 6).alias("delta"))


@query("SELECT r_regionkey AS query_id, CAST(i AS INTEGER) AS batch_no, CASE i WHEN 0 THEN q WHEN 1 THEN upper(q) ELSE 'about ' || q END AS query FROM (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'trade in ' || lower(r_name) ELSE lower(r_name) END AS q FROM region), range(3) t(i) WHERE i = 0 OR r_regionkey % 2 = 0")
def i11_expanded(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS query_id", "CASE WHEN r_regionkey % 2 = 0 THEN concat('trade in ', lower(r_name)) ELSE lower(r_name) END AS query")
    return search.expanded(asked, lambda q: [q, q.upper(), f"about {q}", "one more"])


@query(_RANKED + " SELECT query_id, r.id, printf('%d. [%s] %s (%.2f)' || chr(10) || '   %s', rank, r.chunk_type, r.source_file, CAST(rank / 4 AS DOUBLE), " + _ONE_LINE.format("chunk_text") + ") AS line FROM r JOIN chunks USING (id) WHERE rank <= 20")
def i19_formatted(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ranked(spark, folder).filter("rank <= 20").join(chunks(spark, folder).select("id", "chunk_text"), "id").withColumn("score", F.col("rank") / 4)
    lines = reports.formatted(rows, "query_id", "id")
    return lines.select("query_id", "id", "line")


@query(GRAPH + " SELECT id, confidence, CASE WHEN id IN (11, 31, 51, 12, 22) THEN '2026-04-15' ELSE '2026-02-01' END AS expires FROM (SELECT id, CASE WHEN id IN (11, 31, 51, 12, 22) THEN 0.9::DOUBLE ELSE round(confidence, 6) END AS confidence FROM relations)")
def j06_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    _, relations = graph_of(spark, folder)
    dated = relations.withColumns({"expires_at": F.lit("2026-02-01").cast("timestamp"), "last_confirmed": F.lit(None).cast("timestamp")})
    return graph.confirmed(dated, [11, 31, 51, 12, 22], now()).select("id", F.round("confidence", 6).alias("confidence"), F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@query(
    GRAPH + ", t AS MATERIALIZED (SELECT * FROM relations), changed AS (SELECT id FROM t WHERE source_id % 200 = 11), slugs AS (SELECT lower(n_name) AS slug FROM nation WHERE n_nationkey % 3 = 0) "
    r"SELECT source_id AS id FROM t WHERE id IN (SELECT id FROM changed) UNION SELECT target_id FROM t WHERE id IN (SELECT id FROM changed) UNION SELECT e.id FROM entities e JOIN slugs ON lower(regexp_replace(e.name, '\s+', '-', 'g')) = regexp_replace(slug, '\s+', '-', 'g')"
)
def j15_affected(spark: SparkSession, folder: str) -> DataFrame:
    entities, relations = graph_of(spark, folder)
    evidence = relations.select(F.col("id").alias("relation_id"), F.concat(F.lit("src/"), (F.col("source_id") % 200).cast("string"), F.lit(".py")).alias("source_file"))
    pages = table(spark, folder, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("memory/entities/places/"), F.lower(F.regexp_replace("n_name", r"\s+", "-")), F.lit(".md")).alias("source_file"))
    changed = pages.unionByName(spark.createDataFrame([("src/11.py",)], "source_file string"))
    return graph.affected(changed, entities, relations, evidence)


# --- notes, sessions -------------------------------------------------------------------------------------------------


@query(
    r"WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v: 10%, a@b.de, 12/03/2024 ' ELSE '' END || 'uses ' || source AS t FROM documents) SELECT doc_id AS id, CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS entities, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'doc' END AS source, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS target, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'depends_on' END AS reason FROM documents"
)
def j02_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Structured facts where there are enough, an outside model's triples else."""
    c = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN 'v: 10%, a@b.de, 12/03/2024 ' ELSE '' END, 'uses ', source)").alias("chunk_text"))

    def model(body: str) -> dict:
        return {"entities": [], "relations": [{"source": "doc", "type": "requires", "target": body.split()[1]}]}

    found = extract.with_model(c, model)
    r = F.from_json("relations", "array<struct<source:string,type:string,target:string,reason:string>>")
    one = F.get(r, F.lit(0))
    reason = F.when(one.isNotNull(), text.relation_reason(one["reason"], one["type"]))
    return found.select("id", F.size(F.from_json("entities", "array<struct<name:string>>")).alias("entities"), one["source"].alias("source"), one["target"].alias("target"), reason.alias("reason"))


_DAYS = CHUNKS + ", days AS (SELECT source_file, min(source_date) AS day FROM chunks WHERE chunk_type = 'daily' GROUP BY 1 ORDER BY 2, 1 LIMIT 5), kept AS (SELECT * FROM chunks WHERE source_file IN (SELECT source_file FROM days) AND length(trim(chunk_text)) >= 500), told AS (SELECT source_file, string_agg(chunk_text, chr(10) || chr(10) ORDER BY id) AS t FROM kept GROUP BY 1)"


@query(_DAYS + " SELECT source_file, CAST(1 AS INTEGER) AS status, unnest(['decisions', 'people']) AS kind, unnest([left(t, 40), 'chars ' || length(t)]) AS text FROM told UNION ALL SELECT source_file, CAST(1 AS INTEGER), NULL, NULL FROM days WHERE source_file NOT IN (SELECT source_file FROM told)")
def k05_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 500 characters or more of the five oldest daily files (shorter ones may be noise)."""
    c = chunks(spark, folder)
    days = extract.pending_days(c, spark.createDataFrame([], "source_file string, status int"))
    own = c.withColumn("chunk_text", F.when(F.length(F.trim("chunk_text")) >= 500, F.col("chunk_text")).otherwise("ok"))
    return extract.consolidated(own, days, lambda t: {"decisions": [t[:40]], "people": [f"chars {len(t)}"]})


@query(
    "WITH m AS (SELECT conv_id, turn, '[' || upper(role) || ']: ' || text AS line FROM conversations WHERE length(trim(text)) >= 500 AND conv_id IN (SELECT conv_id FROM conversations WHERE length(trim(text)) >= 500 GROUP BY 1 HAVING count(*) >= 3)), "
    # a block's number goes up where a line doesn't fit what is held
    "s AS (SELECT conv_id, list_reduce(list({'line': '', 'held': length(line) + 1, 'n': 0::BIGINT, 'out': [{'n': 0::BIGINT, 'turn': turn}], 'own': length(line)} ORDER BY turn), lambda a, x: {'line': '', 'held': CASE WHEN a.held + x.own > 2000 THEN x.own + 1 ELSE a.held + x.own + 1 END, 'n': CASE WHEN a.held + x.own > 2000 THEN a.n + 1 ELSE a.n END, 'out': list_append(a.out, {'n': CASE WHEN a.held + x.own > 2000 THEN a.n + 1 ELSE a.n END, 'turn': x.out[1].turn}), 'own': 0}) AS r FROM m GROUP BY 1), "
    "b AS (SELECT conv_id, unnest(r.out) AS o FROM s) SELECT 'c' || b.conv_id AS session_key, o.n AS block, md5(trim(string_agg(m.line, chr(10) ORDER BY m.turn))) AS digest FROM b JOIN m ON m.conv_id = b.conv_id AND m.turn = o.turn GROUP BY ALL"
)
def k07_session_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of 500 characters or more (shorter ones may be noise)."""
    c = table(spark, folder, "conversations").filter("length(trim(text)) >= 500").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_key"), F.col("turn").alias("n"), "role", "text")
    return extract.blocks(c).select("session_key", "block", F.md5("text").alias("digest"))


@query(
    "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS w, 'zz' || md5(text) || ' yy' || md5(source || doc_id) || ' xx' || md5(lang || doc_id) AS t FROM documents) "
    "SELECT 'sessions/atlas/s' || doc_id AS source_file, '[fact|atlas] ' || t AS chunk_text, CASE WHEN w >= 0.8 THEN 'working' ELSE 'peripheral' END AS tier, w AS importance FROM d WHERE w >= 0.5"
)
def k07_distilled(spark: SparkSession, folder: str) -> DataFrame:
    """One memory of each document's block, by a stand-in for the model."""
    d = table(spark, folder, "documents")
    said = F.concat(F.lit("zz"), F.md5("text"), F.lit(" yy"), F.md5(F.concat("source", F.col("doc_id").cast("string"))), F.lit(" xx"), F.md5(F.concat("lang", F.col("doc_id").cast("string"))), F.lit("|"), F.expr("CASE doc_id % 4 WHEN 0 THEN '0.9' WHEN 1 THEN '0.6' ELSE '0.3' END"))
    runs = d.select(F.concat(F.lit("atlas:s"), F.col("doc_id").cast("string")).alias("session_key"), F.lit(0).cast("long").alias("block"), said.alias("text"))
    known = d.select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"))
    out = extract.distilled(runs, lambda t: [{"text": t.split("|")[0], "category": "fact", "importance": float(t.split("|")[1])}], known, now())
    return out.select("source_file", "chunk_text", "tier", "importance")


# --- streams, telemetry ----------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS source_file, o_orderkey AS text FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) = 1")
def p01_latest_files(spark: SparkSession, folder: str) -> DataFrame:
    batch = table(spark, folder, "orders").select(F.col("o_custkey").alias("source_file"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("text"), F.col("o_orderdate").alias("modified"))
    return streams.latest_of_each(batch).select("source_file", F.col("text").cast("long").alias("text"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def o05_queue(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.newest_rows(table(spark, folder, "events").select("event_id"), "event_id")


@query("SELECT h AS hour, NOT (h >= 22 OR h < 6) AS allowed FROM (SELECT DISTINCT CAST(hour(ts) AS INTEGER) AS h FROM events)")
def p08_allowed_hours(spark: SparkSession, folder: str) -> DataFrame:
    hours = table(spark, folder, "events").select(F.hour(F.col("ts").cast("timestamp")).alias("hour")).distinct()
    return hours.withColumn("allowed", streams.allowed_at(F.col("hour"), (22, 6)))


@query(CHUNKS + " SELECT id FROM chunks WHERE starts_with(source_file, 'memory/src1/') OR starts_with(source_file, 'sessions/a_b/')")
def l01_scope(spark: SparkSession, folder: str) -> DataFrame:
    return brief.under(chunks(spark, folder), [*brief.prefixes("memory/src1"), *brief.prefixes("global", "a_b")]).select("id")
