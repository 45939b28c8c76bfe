"""One object for a store of memories: its tables, and the operators as methods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix import schemas, vocab
from engramix.functions import score, text
from engramix.operators import answers, audit, brief, extract, graph, lifecycle, reports, search, telemetry
from engramix.operators.index import SearchIndex, content_of
from engramix.sources import files
from engramix.streaming import streams


class Engine:
    """Tables are Parquet folders under root, named as in schemas; missing ones are empty. as_of is the clock of every method."""

    def __init__(self, spark: SparkSession, root: str, as_of: dt.datetime | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.as_of: Column = F.lit(as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None)).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], schemas.schema(name))
        return schemas.migrated(self.spark.read.parquet(path), name)

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def ingest(self, folder: str, allow_large: bool = False) -> DataFrame:
        """The store's chunks with all files under the folder read anew; write it where the store is, under another version."""
        old = self.table("chunks")
        files.guard_store(old, allow_large)
        new = files.ingest(files.read_tree(self.spark, folder), self.as_of)
        number = F.monotonically_increasing_id() + F.lit(old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1)
        return files.replaced(old, schemas.migrated(new.withColumn("id", number), "chunks"))

    def _searched(self) -> SearchIndex:
        return SearchIndex(self.spark, f"{self.root}/index")

    def build_index(self) -> int:
        """Brings the stored search index to the chunks as they are: what is new, changed or gone is written, the rest stays. Searches
        use it as long as the table of chunks isn't written again. Returns how many chunks were looked at anew."""
        if not files.exists(self.spark, f"{self.root}/chunks"):
            return 0
        return self._searched().refresh(self.table("chunks"), content_of(self.spark, f"{self.root}/chunks"))

    def _index(self) -> dict:
        """The stored index, if it is of the chunks as they are: a search reads the parts of its terms only."""
        if not files.exists(self.spark, f"{self.root}/chunks"):
            return {}
        return self._searched().of(content_of(self.spark, f"{self.root}/chunks"))

    def search(self, query: str, limit: int = 5, vector: list[float] | None = None) -> DataFrame:
        """Hybrid with a query vector, else lexical. AND, OR and NOT (upper case) join words."""
        limit = max(1, min(int(limit), 50))
        chunks = self.table("chunks")
        if vector is None:
            found = search.lexical(self._asked(query), chunks, self.as_of, limit, **self._index())
            return found.select("rank", "score", "id", "chunk_type", "source_file", "chunk_text")
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")
        return search.hybrid(self._asked(query), asked, self.table("vectors"), chunks, self.as_of, limit, **self._index())

    def cross_search(self, query: str, stores: dict[str, str], limit: int = 5) -> DataFrame | None:
        chunks = files.read_stores(self.spark, stores)
        return None if chunks is None else search.across_stores(self._asked(query), chunks, "agent", limit)

    def answer(self, question: str, complete: answers.Completer, k: int = 5, vector: list[float] | None = None) -> dict[str, object]:
        """An answer of an outside model from the hits of search(): hybrid with a vector of the question, else lexical."""
        k = max(1, min(int(k), 20))
        found = self.search(question, 2 * k, vector).select("id", "score")
        rows = search.if_few(found).join(self.table("chunks").select("id", "chunk_text"), "id")
        hits = rows.select(F.lit(0).cast("long").alias("query_id"), "id", F.col("chunk_text").alias("content"), "score", F.sha2("chunk_text", 256).alias("content_hash"))
        return answers.answer(question, hits, complete, k)

    def track(self, found: DataFrame) -> None:
        """Appends what a search has returned to the access log; chunks' counts follow from it (see accessed())."""
        lifecycle.accesses(found, self.as_of).coalesce(1).write.mode("append").parquet(f"{self.root}/access_log")

    def accessed(self) -> DataFrame:
        """The chunks with the accesses of the log."""
        return lifecycle.accessed(self.table("chunks"), self.table("access_log"))

    def decide(self, key: str, content: str, author: str = "", source_file: str = "") -> DataFrame:
        """The row to append to decision_versions, if the content is new."""
        new = self.spark.createDataFrame([(key, content, source_file, author)], "decision_key string, content string, source_file string, author string")
        return graph.decided(self.table("decision_versions"), new, self.as_of)

    def reflect(self, question: str, complete: answers.Completer, vector: list[float] | None = None, use_cache: bool = True) -> dict[str, object]:
        """An answer from the cache or, by an outside model, from search results, entities, decisions and a path between the first two
        entities. `entry` is for remember()."""
        return answers.reflect(question, self.table("reflect_cache"), lambda q: self._evidence(q, vector), complete, self.as_of, vector, use_cache)

    def _evidence(self, question: str, vector: list[float] | None) -> answers.Evidence:
        found = self.search(question, 10, vector)
        rows = found.join(self.table("chunks").select("id", "chunk_text"), "id") if "chunk_text" not in found.columns else found
        chunks = [(r.chunk_text, r.source_file, float(r.score)) for r in rows.orderBy("rank").collect()]  # ten rows
        entities, ids = [], []
        for name in answers.names_in(question):  # five at most
            own = self.table("kg_entities").filter(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy(F.desc("mention_count"), "id").first()
            if own is not None and own.id not in ids:
                near = self.kg_query(name).orderBy(F.desc("id")).limit(5).collect()
                entities.append((own["name"], own.entity_type, [f"{r.relation_type} -> {r.target_name}" for r in near]))
                ids.append(own.id)
        paths = []
        if len(ids) > 1:
            path = self.kg_path(ids[0], ids[1]).first()
            if path is not None:
                names = {r.id: r["name"] for r in self.table("kg_entities").filter(F.col("id").isin(path.path)).collect()}
                paths = [" -> ".join(names.get(i, str(i)) for i in path.path)]
        decisions = [(r.key, r.content) for r in answers.related_decisions(question, self.decisions()).collect()]  # three
        return answers.Evidence(chunks, entities, decisions, paths)

    def remember(self, entry: tuple[str, str, str, list[float] | None], model: str = "model") -> DataFrame:
        """The cache of reflections with a new entry."""
        return answers.remembered(self.table("reflect_cache"), entry, model, self.as_of)

    def brief(self, scope: str, agent: str = "", n: int = 10, budget: int = 1200, since: str = "") -> DataFrame:
        """The briefing of a scope (`global`: all paths) and, if given, an agent's sessions; since: 24h, 30d, 2w."""
        for value, shape, name in ((scope, vocab.SCOPE, "scope"), (agent, vocab.AGENT, "agent"), (since, vocab.SINCE, "since")):
            if (value or name == "scope") and not self._said(value).select(text.valid(F.col("said"), shape)).first()[0]:
                raise ValueError(f"{name}: {value!r}")
        hours = self._said(since).select(text.since_hours(F.col("said"))).first()[0] if since else None
        oldest = None if hours is None else F.timestamp_add("HOUR", F.lit(-hours), self.as_of).cast("date")
        made = brief.build(self.table("chunks"), self.table("brief_log"), self.as_of, scope, agent or None, max(1, min(int(n), 25)), oldest)
        return brief.within_budget(made, budget)

    def kg_query(self, name: str) -> DataFrame:
        return graph.lookup(self.table("kg_entities"), self.table("kg_relations"), name)

    def kg_path(self, start: int | str, end: int | str) -> DataFrame:
        """Between two entities by id, or between the first ones whose names hold the words."""
        if isinstance(start, str) or isinstance(end, str):
            return graph.named_path(self.table("kg_entities"), self.table("kg_relations"), str(start), str(end))
        return graph.shortest_path(self.table("kg_relations"), start, end)

    def kg_impact(self, node: int) -> DataFrame:
        return graph.impact(self.table("kg_entities"), self.table("kg_relations"), node)

    def kg_merge_preview(self) -> DataFrame:
        return graph.merged(self.table("kg_entities")).filter("id <> canonical_id")

    def kg_prune(self) -> DataFrame:
        return graph.decayed(self.table("kg_relations"), self.as_of)

    def tiers(self) -> DataFrame:
        return lifecycle.retier(self.table("chunks"), self.as_of)

    def compact(self, days: int = 30) -> tuple[DataFrame, DataFrame]:
        return lifecycle.compact(self.table("chunks"), self.as_of, days)

    def churn(self, since: dt.date, k: int = 5, least: float = 0.8) -> DataFrame:
        return search.churn(self.table("chunks"), self.table("vectors"), F.lit(since), k, least)

    def stats(self) -> DataFrame:
        return self.table("chunks").groupBy("chunk_type", "tier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_type", "tier")

    def salience(self) -> DataFrame:
        return lifecycle.distribution(self.table("chunks"), self.as_of)

    def primer(self) -> DataFrame:
        return reports.primer(self.table("chunks"), self.as_of)

    def digest(self) -> DataFrame:
        return reports.digest_rows(self.table("chunks"), self.as_of)

    def doctor(self) -> DataFrame:
        return reports.doctor(self.table("chunks"), self.table("vectors"), self.table("consolidated_files"))

    def proposals(self) -> DataFrame:
        return telemetry.proposals(self.table("cli_telemetry"), self.as_of)

    def audit(self) -> DataFrame:
        return telemetry.audit_breakdown(audit.present(self.table("ops_audit")), self.as_of)

    def audited(self, op_name: str, db_source: str | None = None):
        """`with engine.audited("reindex") as run:` writes the run's begin and end to the log; run.heartbeat() in between."""
        return audit.audited(self.spark, f"{self.root}/ops_audit", op_name, db_source)

    def give_up(self, quiet: str = "6 hours") -> int:
        """Ends runs whose heartbeat has stopped, and tells how many."""
        log = self.table("ops_audit")
        dead = audit.given_up(audit.present(log), quiet, as_of=self.as_of)
        n = dead.count()
        if n:
            dead.coalesce(1).write.mode("append").parquet(f"{self.root}/ops_audit")
        return n

    def decisions(self) -> DataFrame:
        return graph.decision_history(self.table("decision_versions").withColumnRenamed("decision_key", "key").drop("superseded_at", "is_current"))

    def decision_history(self, key: str) -> DataFrame:
        return self.decisions().filter(F.col("key") == key).orderBy("version")

    def decision_get(self, key: str) -> DataFrame:
        return self.decision_history(key).filter("is_current")

    def kg_build(self, names: dict[str, list[str]], aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Entities and edges of co-occurrence in all chunks; names: known persons, projects and agents by type."""
        return graph.build(self.table("chunks"), names, aliases)

    def kg_stats(self) -> DataFrame:
        return self.table("kg_entities").groupBy("entity_type").agg(F.count("*").alias("entities"), F.sum("mention_count").alias("mentions")).orderBy(F.desc("entities"), "entity_type")

    def kg_facts(self, query: str, k: int = 8) -> DataFrame:
        return graph.vault_facts(self._asked(query), self.table("kg_entities"), self.table("kg_relations"), max(1, min(int(k), 32)))

    def kg_extract(self, model) -> DataFrame:
        """Triples of all chunks: structured facts and rules first, the outside model for the rest."""
        chunks = self.table("chunks")
        found = extract.by_rule(chunks)
        asked = extract.needs_model(chunks, found).filter("model").drop("model")
        said = extract.model_relations(extract.with_model(asked, model)).select("id", "relation_type", "target")
        return extract.combined(found, said)

    def cross_kg(self, stores: dict[str, str]) -> DataFrame | None:
        entities = files.read_stores(self.spark, stores)
        return None if entities is None else graph.merge_stores(entities)

    def tier_stats(self) -> DataFrame:
        return self.table("chunks").groupBy("tier", "section").agg(F.count("*").alias("n")).orderBy("tier", "section")

    def retention_stats(self) -> DataFrame:
        return lifecycle.retention_buckets(self.table("chunks"))

    def archive_candidates(self) -> DataFrame:
        return lifecycle.archive_candidates(self.table("chunks"), self.as_of)

    def pull_shared(self, agent: str) -> DataFrame:
        return lifecycle.shared_for(self.table("shared_chunks"), agent)

    def shared_stats(self) -> DataFrame:
        return self.table("shared_chunks").groupBy("source_agent", "chunk_type").agg(F.count("*").alias("n"))

    def insights(self) -> tuple[DataFrame, DataFrame]:
        """Contradictions between decisions and lessons, and topics of recent decisions."""
        return lifecycle.contradictions(self.table("chunks")), lifecycle.topics(self.table("chunks"), self.as_of)

    def profile(self) -> DataFrame:
        return reports.profile(self.table("kg_entities"), self.table("chunks"), self.as_of)

    def search_stats(self) -> DataFrame:
        return telemetry.search_rollup(self.table("search_telemetry"), self.as_of)

    def provider_costs(self) -> DataFrame:
        return telemetry.provider_costs(self.table("provider_telemetry"), self.as_of)

    def coverage(self) -> DataFrame:
        return telemetry.coverage(self.table("chunks"), self.table("vectors"))

    def vectorize(self, embed, dim: int) -> DataFrame:
        """Vectors for the chunks that have none, by an outside service."""
        return files.embedded(files.missing_vectors(self.table("chunks"), self.table("vectors")), embed, dim)

    def pending_days(self) -> DataFrame:
        return extract.pending_days(self.table("chunks"), self.table("consolidated_files"))

    def _learned(self) -> list[str]:
        return [r.text_original for r in self.table("noise_prototypes").select("text_original").collect()]  # short phrases that were learned

    def consolidate(self, model) -> DataFrame:
        return extract.consolidated(self.table("chunks"), self.pending_days(), model, self._learned())

    def consolidation_lines(self, found: DataFrame) -> DataFrame:
        """What consolidate() found as lines for the files of notes, without what the store holds already."""
        return extract.sink_lines(found, self.table("chunks"))

    def learned_noise(self, found: DataFrame) -> DataFrame:
        return extract.learned_noise(self.table("chunks"), found)

    def distill(self, path: str, model=None) -> DataFrame:
        """Blocks of text of session logs, ready for a model; with a model, the memories that it finds in them."""
        runs = extract.blocks(files.read_sessions(self.spark, path), learned=self._learned())
        return runs if model is None else extract.distilled(runs, model, self.table("chunks"), self.as_of)

    def take_in(self, events: DataFrame) -> DataFrame:
        """Chunks of the valid events that the store doesn't hold."""
        return streams.taken_in(events, self.table("chunks").filter("metadata is not null"), self.as_of)

    def error(self, kind: str, message: str) -> DataFrame:
        return self._said(message).select(extract.public_error(F.lit(kind), F.col("said")).alias("e")).select("e.*")

    def merge_candidates(self, evidence: DataFrame, protected: list[str] | None = None) -> DataFrame:
        return graph.merge_candidates(self.table("kg_entities"), evidence, protected=protected)

    def kg_block(self, query: str, k: int = 8) -> DataFrame:
        return graph.facts_block(self.kg_facts(query, k))

    def watch(self, folder: str, handle, checkpoint: str, every: str | None = None, quiet: str = "2 seconds"):
        """What is in the folder now goes to handle; with `every`, also each file from then on when it hasn't changed for `quiet`."""
        files_of = streams.watch_files(self.spark, folder)
        if every:
            files_of = streams.settled(streams.clock(files_of), quiet).drop("changes", "first")
        return streams.run_ingest(files_of, handle, checkpoint, every)

    def _said(self, value: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], "said string")

    def redact(self, value: str) -> DataFrame:
        return self._said(value).select(text.redacted(F.col("said")).alias("r")).select("r.*")

    def noise_check(self, value: str) -> DataFrame:
        return self._said(value).select(text.is_noise(F.col("said")).alias("noise"))

    def temporal(self, query: str) -> DataFrame:
        return self._said(query).select(text.temporal_intent(F.col("said"), self.as_of).alias("i")).select("i.*")

    def classify(self, path: str) -> DataFrame:
        kind = text.chunk_type(F.col("said"))
        return self._said(path).select(kind.alias("chunk_type"), text.path_kind(F.col("said")).alias("source_type"), text.path_date(F.col("said")).alias("source_date"), lifecycle.default_retention(kind).alias("retention_days"), score.importance(F.lit(None).cast("double"), kind).alias("importance"))
