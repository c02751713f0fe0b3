"""Project and theme candidates from sessions, each with the evidence it rests on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.numeric import session_time
from talkmill.functions.text import strip_ws
from talkmill.operators.provenance import sessions_missing_evidence
from talkmill.schema import conform, empty_table, make_id

# Lengths, scores and explanations of the built-in extraction.
TITLE_CHARS = 500
LABEL_CHARS = 120
EXCERPT_CHARS = 500
CANDIDATE_SCORE = 0.35
PROJECT_EXPLANATION = (
    "Stub extraction: session title or first user line, plus first user message (local, deterministic)."
)
THEME_EXPLANATION = "Stub theme: label from session title or first user line (local, deterministic)."


@dataclass(frozen=True)
class Extracted:
    projects: DataFrame
    evidence: DataFrame


# A provider turns (sessions, messages, artifacts, as_of) into project candidates with evidence.
ExtractionProvider = Callable[[DataFrame, DataFrame, DataFrame, Column], Extracted]


def session_openings(messages: DataFrame) -> DataFrame:
    """Per session: first user message (id, label, excerpt) and the first and last message times.

    Texts are cut before the aggregate, so only short strings move.
    """
    user_order = F.when(F.col("role") == "user", F.col("sort_order"))
    opening = F.struct(
        F.col("id").alias("message_id"),
        F.substring(strip_ws(F.col("content_text")), 1, LABEL_CHARS).alias("label"),
        F.substring("content_text", 1, EXCERPT_CHARS).alias("excerpt"),
    )
    user_opening = F.when(F.col("role") == "user", opening)
    return (
        messages.select("session_id", "sort_order", "timestamp", user_order.alias("u"), user_opening.alias("o"))
        .groupBy("session_id")
        .agg(
            F.min_by("o", "u").alias("opening"),
            F.min_by("timestamp", "sort_order").alias("first_ts"),
            F.max_by("timestamp", "sort_order").alias("last_ts"),
        )
    )


def _with_openings(sessions: DataFrame, messages: DataFrame, as_of: Column, how: str) -> DataFrame:
    rows = sessions.withColumnRenamed("id", "session_id").join(session_openings(messages), "session_id", how)
    first = F.coalesce("first_ts", "started_at", as_of)
    return rows.withColumn("first_seen_at", first).withColumn(
        "last_seen_at", F.coalesce("last_ts", "updated_at", "started_at", "first_seen_at")
    )


def extract_projects(
    sessions: DataFrame, messages: DataFrame, artifacts: DataFrame | None, as_of: Column
) -> Extracted:
    """One speculative project for each session that has a user message and something to call it by."""
    rows = _with_openings(sessions, messages, as_of, "inner").filter(F.col("opening").isNotNull())
    title = F.coalesce(F.nullif(strip_ws(F.col("title")), F.lit("")), F.nullif(F.col("opening.label"), F.lit("")))
    rows = rows.withColumn("name", F.substring(title, 1, TITLE_CHARS)).filter(F.col("name").isNotNull())
    rows = rows.withColumn("project_id", make_id("project", F.col("session_id")))
    projects = rows.select(
        F.col("project_id").alias("id"), F.col("name").alias("canonical_title"),
        F.lit("speculative").alias("status"), F.lit(CANDIDATE_SCORE).alias("confidence"),
        "first_seen_at", "last_seen_at", F.lit(1).alias("source_span_count"),
    )
    return Extracted(
        conform(projects, "projects"),
        _evidence(rows, "project", F.col("project_id"), PROJECT_EXPLANATION, as_of),
    )


def extract_nothing(sessions: DataFrame, messages: DataFrame, artifacts: DataFrame | None, as_of: Column) -> Extracted:
    """The provider that finds nothing."""
    spark = sessions.sparkSession
    return Extracted(empty_table(spark, "projects"), empty_table(spark, "evidence_links"))


def _evidence(rows: DataFrame, entity_type: str, entity_id: Column, explanation: str, as_of: Column) -> DataFrame:
    links = rows.select(
        make_id("evidence", F.lit(entity_type), entity_id, F.col("session_id")).alias("id"),
        F.lit(entity_type).alias("entity_type"), entity_id.alias("entity_id"), "session_id",
        F.col("opening.message_id").alias("message_id"), F.col("opening.excerpt").alias("excerpt"),
        F.lit(explanation).alias("explanation"), F.lit(CANDIDATE_SCORE).alias("evidence_score"),
        as_of.alias("created_at"),
    )
    return conform(links, "evidence_links")


def extract_missing(
    sessions: DataFrame,
    messages: DataFrame,
    artifacts: DataFrame | None,
    evidence: DataFrame,
    as_of: Column,
    provider: ExtractionProvider = extract_projects,
    max_sessions: int | None = None,
) -> Extracted:
    """Extraction for sessions without project evidence, newest first.

    ``max_sessions`` counts the sessions that yielded something, as the option is meant.
    """
    todo = sessions_missing_evidence(sessions, evidence, "project")
    found = provider(todo, messages, artifacts, as_of)
    if max_sessions is None:
        return found
    yielded = found.evidence.select(F.col("session_id").alias("id")).distinct()
    taken = (
        todo.join(yielded, "id", "left_semi")
        .select("id", session_time().alias("at"))
        .orderBy(F.desc("at"), "id")
        .limit(max_sessions)
        .select(F.col("id").alias("session_id"))
    )
    links = found.evidence.join(taken, "session_id", "left_semi")
    used = links.select(F.col("entity_id").alias("id")).distinct()
    return Extracted(
        conform(found.projects.join(used, "id", "left_semi"), "projects"), conform(links, "evidence_links")
    )


def assign_themes(
    sessions: DataFrame, messages: DataFrame, themes: DataFrame, evidence: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """New themes and new theme evidence for sessions that have none.

    A theme is found by its exact label. A new one takes its time span from the newest session that carries
    the label, and later sessions do not widen it. Labels are combined per label before anything is joined.
    """
    todo = sessions_missing_evidence(sessions, evidence, "theme")
    rows = _with_openings(todo, messages, as_of, "left")
    label = F.coalesce(
        F.nullif(F.substring(strip_ws(F.col("title")), 1, LABEL_CHARS), F.lit("")),
        F.nullif(F.col("opening.label"), F.lit("")),
    )
    rows = rows.withColumn("label", label).filter(F.col("label").isNotNull())
    newest = F.struct((-F.unix_micros(session_time())).alias("age"), "session_id")
    seen = F.min_by(F.struct("first_seen_at", "last_seen_at"), newest)
    labels = rows.groupBy("label").agg(seen.alias("seen"))
    known = themes.groupBy("label").agg(F.min("id").alias("known_id"))
    resolved = labels.join(known, "label", "left").withColumn(
        "theme_id", F.coalesce("known_id", make_id("theme", F.col("label")))
    )
    new_themes = resolved.filter(F.col("known_id").isNull()).select(
        F.col("theme_id").alias("id"), "label", F.lit(CANDIDATE_SCORE).alias("confidence"),
        F.col("seen.first_seen_at").alias("first_seen_at"), F.col("seen.last_seen_at").alias("last_seen_at"),
    )
    # Only a label that was there before needs a lookup; a new theme's id follows from its label.
    linked = rows.join(known, "label", "left").withColumn(
        "theme_id", F.coalesce("known_id", make_id("theme", F.col("label")))
    )
    links = _evidence(linked, "theme", F.col("theme_id"), THEME_EXPLANATION, as_of)
    return conform(new_themes, "themes"), links
