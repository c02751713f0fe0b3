"""Evidence: from an entity to the sessions that support it, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_for(evidence: DataFrame, entity_type: str, entity_ids: DataFrame) -> DataFrame:
    """Links of the given entities (column id), newest first."""
    wanted = entity_ids.select(F.col("id").alias("entity_id"))
    links = evidence.filter(F.col("entity_type") == entity_type)
    return links.join(wanted, "entity_id", "left_semi").orderBy("entity_id", F.desc("created_at"), "id")


def evidence_of_sessions(evidence: DataFrame, session_ids: DataFrame) -> DataFrame:
    wanted = session_ids.select(F.col("id").alias("session_id"))
    return evidence.join(wanted, "session_id", "left_semi").orderBy("session_id", F.desc("created_at"), "id")


def latest_evidence(evidence: DataFrame, entity_type: str, entity_ids: DataFrame) -> DataFrame:
    """The newest link of each entity: entity_id, session_id, message_id, excerpt."""
    wanted = entity_ids.select(F.col("id").alias("entity_id")).distinct()
    links = evidence.filter(F.col("entity_type") == entity_type).join(wanted, "entity_id", "left_semi")
    newest = F.max_by(F.struct("session_id", "message_id", "excerpt"), F.struct("created_at", "id"))
    return links.groupBy("entity_id").agg(newest.alias("e")).select("entity_id", "e.*")


def sessions_with_evidence(sessions: DataFrame, evidence: DataFrame, entity_type: str) -> DataFrame:
    return sessions.join(_sessions_of(evidence, entity_type), "id", "left_semi")


def sessions_missing_evidence(sessions: DataFrame, evidence: DataFrame, entity_type: str) -> DataFrame:
    return sessions.join(_sessions_of(evidence, entity_type), "id", "left_anti")


def _sessions_of(evidence: DataFrame, entity_type: str) -> DataFrame:
    return evidence.filter(F.col("entity_type") == entity_type).select(F.col("session_id").alias("id")).distinct()


def entity_detail(
    entities: DataFrame, entity_type: str, label: str, evidence: DataFrame, sessions: DataFrame
) -> DataFrame:
    """One row per (entity, session): number of links, newest link and the session's title."""
    links = (
        evidence.filter(F.col("entity_type") == entity_type)
        .groupBy("entity_id", "session_id")
        .agg(F.count("*").alias("link_count"), F.max("created_at").alias("newest_link_at"))
    )
    named = entities.select(F.col("id").alias("entity_id"), F.col(label).alias("label"))
    titles = sessions.select(F.col("id").alias("session_id"), F.col("title").alias("session_title"))
    return named.join(links, "entity_id").join(titles, "session_id", "left")


def provenance_audit(
    evidence: DataFrame, entities: dict[str, DataFrame], sessions: DataFrame, messages: DataFrame | None = None
) -> DataFrame:
    """Broken provenance: entities without evidence, and links to rows that are not there.

    Columns: problem, entity_type, ref_id. Links are reduced to distinct references before each anti join.
    """
    problems = []
    for entity_type, rows in entities.items():
        linked = evidence.filter(F.col("entity_type") == entity_type).select(F.col("entity_id").alias("id")).distinct()
        ids = rows.select("id")
        problems.append(_problem(ids.join(linked, "id", "left_anti"), "entity_without_evidence", entity_type))
        problems.append(_problem(linked.join(ids, "id", "left_anti"), "missing_entity", entity_type))
    referred = [("missing_session", "session_id", sessions)]
    if messages is not None:
        referred.append(("missing_message", "message_id", messages))
    for problem, column, target in referred:
        refs = (
            evidence.filter(F.col(column).isNotNull())
            .select("entity_type", F.col(column).alias("id"))
            .distinct()
        )
        missing = refs.join(target.select("id"), "id", "left_anti")
        problems.append(missing.select(F.lit(problem).alias("problem"), "entity_type", F.col("id").alias("ref_id")))
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out


def _problem(ids: DataFrame, problem: str, entity_type: str) -> DataFrame:
    return ids.select(
        F.lit(problem).alias("problem"), F.lit(entity_type).alias("entity_type"), F.col("id").alias("ref_id")
    )
