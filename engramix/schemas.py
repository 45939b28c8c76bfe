"""Schemas of the memory tables, and stores that may lack columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 18
_DDL = {
    "chunks": "id long, source_file string, chunk_text string, chunk_type string, source_date date, is_consolidated int, created_at timestamp, updated_at timestamp, metadata string, memory_type string, tier string, access_count int, last_accessed_at timestamp, importance double, source_type string, is_compiled int, retention_days int, pain double, section string, section_boost double",
    "vectors": "id long, embedding array<float>",
    "kg_entities": "id long, name string, entity_type string, attributes string, first_seen timestamp, last_seen timestamp, mention_count long",
    "kg_relations": "id long, source_id long, relation_type string, target_id long, evidence_chunk_id long, confidence double, created_at timestamp, expires_at timestamp, last_confirmed timestamp, reason string",
    "decision_versions": "decision_key string, version long, content string, source_file string, author string, created_at timestamp, superseded_at timestamp, is_current boolean",
    "consolidated_files": "source_file string, status int, processed_at timestamp",
    "dedup_log": "chunk_text_preview string, source_file string, chunk_type string, suppressed_at timestamp, reason string",
    "search_telemetry": "ts timestamp, query_hash string, query_words int, variants_count int, results_count int, has_semantic boolean, latency_ms double, expansion_skipped_reason string",
    "access_log": "id long, accessed_at timestamp",
    "brief_log": "id long, chunk_id long, scope string, agent string, served_at timestamp",
    "noise_prototypes": "text_normalized string, text_original string, is_builtin boolean, hit_count long, created_at timestamp",
    "reflect_cache": "query_hash string, query string, response string, evidence_sources string, model string, created_at timestamp, ttl_hours int, cached_embedding array<float>",
    "shared_chunks": "source_agent string, chunk_text string, chunk_type string, tags string, shared_at timestamp, propagated_to string, share_reason string",
    "ops_audit": "op_id long, op_name string, started_at timestamp, finished_at timestamp, duration_ms long, status string, affected_rows long, pid long, error_message string, notes string, db_source string, last_heartbeat_at timestamp",
    "answer_telemetry": "question_hash string, session_id string, ts timestamp, provider string, model string, retrieval_count int, citation_count int, tokens_in long, tokens_out long, latency_ms long, fallback_used boolean, failed_reason string, cost_usd double",
    "provider_telemetry": "ts timestamp, provider string, model string, kind string, tokens_in long, tokens_out long, cost_usd double, latency_ms long, ok boolean, caller string, session_id string, error_kind string",
    "cli_telemetry": "command string, status string, duration_ms double, ts timestamp",
}
_DEFAULTS = {"chunks": {"tier": "peripheral", "access_count": 0, "importance": 0.5, "is_compiled": 0, "pain": 0.2}, "kg_relations": {"confidence": 0.8, "reason": "unknown"}, "kg_entities": {"mention_count": 1}}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def migrated(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order: missing ones are added with their defaults or null, kinds are cast; others stay behind."""
    defaults = _DEFAULTS.get(table, {})
    out = []
    for f in schema(table).fields:
        out.append((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name))
    return df.select(*out)


def source_type_of(rows: DataFrame) -> DataFrame:
    """source_type where it is missing: compiled, then external, user statements, timeline, else null."""
    kind = F.when(F.col("is_compiled") == 1, "compiled").when(F.col("source_file").rlike(r"(?i)graph:|https?://"), "external").when(F.col("chunk_type") == "feedback", "user_statement").when(F.col("section") == "timeline", "timeline")
    return rows.withColumn("source_type", F.coalesce("source_type", kind))
