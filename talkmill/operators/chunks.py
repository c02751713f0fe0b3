"""Overlapping text windows of messages and artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.rows import each_struct
from talkmill.functions.text import WINDOW_CHARS, WINDOW_OVERLAP, windows
from talkmill.schema import SEARCH_INDEX_VERSION, conform, make_id


def build_chunks(
    messages: DataFrame, artifacts: DataFrame, max_chars: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP
) -> DataFrame:
    """One row per window, map-only."""
    said = messages.select(
        "session_id", F.col("id").alias("message_id"), F.lit(None).cast("string").alias("artifact_id"),
        F.lit("message").alias("chunk_type"), "content_text",
    )
    made = artifacts.select(
        "session_id", "message_id", F.col("id").alias("artifact_id"),
        F.lit("artifact").alias("chunk_type"), "content_text",
    )
    parts = each_struct(
        said.unionByName(made), windows(F.col("content_text"), max_chars, overlap), "start_offset",
        "session_id", "message_id", "artifact_id", "chunk_type",
    )
    key = make_id("chunk", F.col("session_id"), F.col("message_id"), F.col("artifact_id"), F.col("start_offset"))
    return conform(parts.withColumn("id", key), "chunks")


def reindex_stale(
    batches: DataFrame,
    sessions: DataFrame,
    messages: DataFrame,
    artifacts: DataFrame,
    chunks: DataFrame,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    version: int = SEARCH_INDEX_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Rebuild the chunks of completed batches with an older index version.

    Returns (chunks, batches). Chunks of other sessions are kept as they are.
    """
    stale = (F.col("status") == "completed") & (F.col("search_index_version") < version)
    due = batches.filter(stale).select(F.col("id").alias("import_batch_id"))
    due_sessions = sessions.join(due, "import_batch_id", "left_semi").select(F.col("id").alias("session_id"))
    kept = chunks.join(due_sessions, "session_id", "left_anti")
    rebuilt = build_chunks(
        messages.join(due_sessions, "session_id", "left_semi"),
        artifacts.join(due_sessions, "session_id", "left_semi"),
    )
    if embed is not None:
        rebuilt = embed(rebuilt)
    raised = batches.withColumn(
        "search_index_version", F.when(stale, F.lit(version)).otherwise(F.col("search_index_version"))
    )
    return conform(kept, "chunks").unionByName(conform(rebuilt, "chunks")), raised


def resolve_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where a hit leads: its artifact when it has one, and the message."""
    places = chunks.select(
        F.col("id").alias("chunk_id"), F.col("artifact_id"), F.col("message_id").alias("chunk_message_id"),
        "start_offset", "end_offset",
    )
    target: Column = F.coalesce("artifact_id", "chunk_message_id")
    return hits.join(places, "chunk_id").withColumn("target_id", target).withColumn(
        "target_type",
        F.when(F.col("artifact_id").isNotNull(), "artifact").when(F.col("chunk_message_id").isNotNull(), "message"),
    )
