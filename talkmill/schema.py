"""Canonical tables, closed value sets and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories of patterns.
PATTERN_CATEGORIES = ["behavioral", "cognitive", "workflow", "temporal", "other"]

# Raise when chunking or tokenising changes, so that older batches are indexed again.
SEARCH_INDEX_VERSION = 1

TABLES = {
    "sources": "id string, type string, name string, version string, adapter_key string, "
               "created_at timestamp, updated_at timestamp",
    "import_batches": "id string, source_id string, imported_at timestamp, file_name string, file_hash string, "
                      "parser_version string, status string, session_count bigint, warning_count bigint, "
                      "search_index_version int",
    "sessions": "id string, source_id string, import_batch_id string, external_id string, title string, "
                "started_at timestamp, ended_at timestamp, session_type string, metadata map<string,string>, "
                "created_at timestamp, updated_at timestamp",
    "messages": "id string, session_id string, role string, author_label string, timestamp timestamp, "
                "content_text string, content_hash string, raw_payload string, sort_order int",
    "artifacts": "id string, session_id string, message_id string, artifact_type string, title string, "
                 "content_text string, mime_type string",
    "chunks": "id string, session_id string, message_id string, artifact_id string, chunk_type string, "
              "text string, start_offset int, end_offset int, embedding array<double>",
    "projects": "id string, canonical_title string, description string, status string, confidence double, "
                "momentum_score double, first_seen_at timestamp, last_seen_at timestamp, source_span_count bigint, "
                "next_action_summary string",
    "themes": "id string, label string, description string, confidence double, recurrence_score double, "
              "first_seen_at timestamp, last_seen_at timestamp",
    "patterns": "id string, label string, description string, category string, confidence double, "
                "impact_score double, first_seen_at timestamp, last_seen_at timestamp",
    "recommendations": "id string, title string, rationale string, recommendation_type string, "
                       "priority_score double, actionability_score double, grounding_score double, "
                       "created_at timestamp, dismissed_at timestamp, accepted_at timestamp",
    "evidence_links": "id string, entity_type string, entity_id string, session_id string, message_id string, "
                      "artifact_id string, chunk_id string, excerpt string, explanation string, "
                      "evidence_score double, created_at timestamp",
    "session_analytics": "session_id string, message_count bigint, user_msg_count bigint, "
                         "assistant_msg_count bigint, word_count bigint, duration_minutes double, "
                         "top_keywords array<string>, computed_at timestamp",
    "project_merge_candidates": "project_a_id string, project_b_id string, score_combined double, "
                                "score_title double, score_description double, score_temporal double, "
                                "computed_at timestamp",
    "project_merge_decisions": "surviving_project_id string, merged_project_id string, decided_at timestamp, "
                               "notes string",
    "user_profile": "id string, summary string, strengths array<string>, growth_areas array<string>, "
                    "work_style string, model_used string, session_count_at_computation bigint, "
                    "computed_at timestamp",
    "parse_warnings": "import_batch_id string, code string, message string, context map<string,string>",
    "goals": "id string, title string, description string, horizon string, confidence double, status string, "
             "first_seen_at timestamp, last_seen_at timestamp",
    "interests": "id string, label string, strength double, first_seen_at timestamp, last_seen_at timestamp",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def make_id(*parts: Column | str) -> Column:
    """Id from the natural key; the same row gets the same id on every retry and rerun.

    A null part is encoded apart from an empty one, so the two never share an id.
    """
    encoded = []
    for part in parts:
        col = F.lit(part) if isinstance(part, str) else part.cast("string")
        encoded.append(F.coalesce(F.concat(F.lit("v"), col), F.lit("n")))
    return F.sha2(F.concat_ws("\x1f", *encoded), 256)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the canonical columns of a table, adding missing ones as null."""
    have = set(df.columns)
    cols = []
    for field in TABLES[name].split(", "):
        col, dtype = field.split(" ", 1)
        cols.append((F.col(col) if col in have else F.lit(None)).cast(dtype).alias(col))
    return df.select(*cols)
