"""Recommendations from project, theme and session state, and their life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import round_half_up, session_time
from talkmill.functions.text import strip_ws
from talkmill.operators.dashboards import OPEN
from talkmill.operators.provenance import latest_evidence
from talkmill.schema import conform, make_id
from talkmill.session import cut_lineage

# Limits, scores and texts of the generators.
STALLED_MIN_SESSIONS, STALLED_LIMIT = 3, 5
CONSOLIDATE_MIN_SCORE, CONSOLIDATE_LIMIT = 0.6, 3
RISING_MIN_RECENT, RISING_LIMIT = 5, 3
REVISIT_MIN_MESSAGES, REVISIT_MIN_WORDS, REVISIT_MIN_DAYS, REVISIT_LIMIT = 10, 2000, 30, 5
NAME_CHARS, PAIR_NAME_CHARS = 80, 40
SEED_TITLE = "Review speculative projects"
SEED_RATIONALE = (
    "Speculative projects were created from your chat titles. Skim the list and archive or refine what still matters."
)
SEED_EXPLANATION = "Grounded to your first project (or first session) — stub recommendation for the MVP."
SEED_EXCERPT_CHARS = 200
SECTIONS = [
    ("revive_stalled", "Stalled Projects"),
    ("consolidate", "Consolidation Opportunities"),
    ("reflect_pattern", "Active Patterns"),
    ("revisit_decision", "Worth Revisiting"),
    ("next_action", "Next Actions"),
    ("extract_plan", "Extract Plans"),
]


@dataclass(frozen=True)
class Generated:
    """New recommendations with their evidence, and how many candidates were created and skipped."""

    recommendations: DataFrame
    evidence: DataFrame
    counts: DataFrame


def _candidates(
    rows: DataFrame, generator: int, kind: str, title: Column, rationale: Column, priority: Column,
    actionability: float, grounding: float, order: list[Column | str],
) -> DataFrame:
    """Common shape of a generator's few rows, numbered in its order."""
    rank = F.row_number().over(Window.partitionBy(F.lit(generator)).orderBy(*order))
    return rows.select(
        F.lit(generator).alias("generator"), rank.alias("place"), F.lit(kind).alias("recommendation_type"),
        title.alias("title"), rationale.alias("rationale"), priority.cast("double").alias("priority_score"),
        F.lit(actionability).alias("actionability_score"), F.lit(grounding).alias("grounding_score"),
        "entity_type", "entity_id",
    )


def _anchored(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach the entity's newest evidence. The limit was applied before, so a row without any is lost."""
    kinds = ["project", "theme"]
    anchors = None
    for kind in kinds:
        ids = candidates.filter(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"))
        one = latest_evidence(evidence, kind, ids).withColumn("entity_type", F.lit(kind))
        anchors = one if anchors is None else anchors.unionByName(one)
    return candidates.join(anchors, ["entity_type", "entity_id"])


def stalled_candidates(activity: DataFrame, min_sessions: int = STALLED_MIN_SESSIONS, limit: int = STALLED_LIMIT) -> DataFrame:
    order = [F.desc("last_seen_at"), F.col("id")]
    rows = activity.filter((F.col("status") == "stalled") & (F.col("session_count") >= min_sessions))
    rows = rows.orderBy(*order).limit(limit).withColumn("entity_type", F.lit("project")).withColumn("entity_id", F.col("id"))
    n, days = F.col("session_count").cast("string"), F.col("days_since_last_activity").cast("string")
    rationale = F.concat(
        F.lit("This project was active across "), n, F.lit(" sessions but hasn't had activity in "), days,
        F.lit(" days. Consider picking it back up or archiving it."),
    )
    title = F.concat(F.lit("Resume: "), F.substring("canonical_title", 1, NAME_CHARS))
    priority = F.least(F.lit(0.5) + F.col("session_count") * F.lit(0.05), F.lit(0.85))
    return _candidates(rows, 1, "revive_stalled", title, rationale, priority, 0.7, 0.6, order)


def consolidation_candidates(listed: DataFrame, min_score: float = CONSOLIDATE_MIN_SCORE, limit: int = CONSOLIDATE_LIMIT) -> DataFrame:
    order = [F.desc("score_combined"), F.col("project_a_id"), F.col("project_b_id")]
    rows = listed.filter(F.col("score_combined") > min_score).orderBy(*order).limit(limit)
    rows = rows.withColumn("entity_type", F.lit("project")).withColumn("entity_id", F.col("project_a_id"))
    percent = round_half_up(F.col("score_combined") * 100).cast("bigint").cast("string")
    title = F.concat(
        F.lit('Merge: "'), F.substring("title_a", 1, PAIR_NAME_CHARS), F.lit('" and "'),
        F.substring("title_b", 1, PAIR_NAME_CHARS), F.lit('"'),
    )
    rationale = F.concat(
        F.lit("These two projects have "), percent,
        F.lit("% similarity. Consider merging them to consolidate your work history."),
    )
    return _candidates(rows, 2, "consolidate", title, rationale, F.least("score_combined", F.lit(0.9)), 0.8, 0.7, order)


def rising_candidates(recurrence: DataFrame, min_recent: int = RISING_MIN_RECENT, limit: int = RISING_LIMIT) -> DataFrame:
    order = [F.desc("session_count"), F.desc("last_seen_at"), F.col("id")]
    rows = recurrence.filter((F.col("recent_count") >= min_recent) & (F.col("trend") == "rising"))
    rows = rows.orderBy(*order).limit(limit).withColumn("entity_type", F.lit("theme")).withColumn("entity_id", F.col("id"))
    rationale = F.concat(
        F.lit("This theme appeared in "), F.col("recent_count").cast("string"),
        F.lit(" sessions over the last 2 weeks and is trending upward. "
              "Consider whether this deserves a dedicated project."),
    )
    title = F.concat(F.lit("Active topic: "), F.substring("label", 1, NAME_CHARS))
    priority = F.least(F.lit(0.5) + F.col("recent_count") * F.lit(0.05), F.lit(0.85))
    return _candidates(rows, 3, "reflect_pattern", title, rationale, priority, 0.6, 0.65, order)


def revisit_candidates(
    analytics: DataFrame, sessions: DataFrame, as_of: Column, min_messages: int = REVISIT_MIN_MESSAGES,
    min_words: int = REVISIT_MIN_WORDS, min_days: int = REVISIT_MIN_DAYS, limit: int = REVISIT_LIMIT,
) -> DataFrame:
    """Long sessions that are some time back; each is its own evidence."""
    long = analytics.filter((F.col("message_count") >= min_messages) & (F.col("word_count") >= min_words))
    old = sessions.filter(F.to_date(session_time()) <= F.date_sub(F.to_date(as_of), min_days))
    rows = long.select("session_id", "message_count", "word_count").join(
        old.select(F.col("id").alias("session_id"), "title", "started_at"), "session_id"
    )
    order = [F.desc("word_count"), F.col("session_id")]
    rows = rows.orderBy(*order).limit(limit).withColumn("entity_type", F.lit("session")).withColumn("entity_id", F.col("session_id"))
    name = F.coalesce(F.nullif(strip_ws(F.col("title")), F.lit("")), F.lit("Untitled session"))
    day = F.coalesce(F.date_format("started_at", "yyyy-MM-dd"), F.lit("unknown date"))
    rationale = F.concat(
        F.lit("This session from "), day, F.lit(" had "), F.col("message_count").cast("string"),
        F.lit(" messages and "), F.format_number("word_count", 0),
        F.lit(" words — a substantial discussion worth revisiting."),
    )
    title = F.concat(F.lit("Revisit: "), F.substring(name, 1, NAME_CHARS))
    priority = F.least(F.lit(0.4) + F.col("word_count") / F.lit(10000), F.lit(0.75))
    return _candidates(rows, 4, "revisit_decision", title, rationale, priority, 0.5, 0.8, order)


def generate_recommendations(candidates: list[DataFrame], evidence: DataFrame, existing: DataFrame, as_of: Column) -> Generated:
    """Turn the generators' candidates into recommendations, once per title.

    A title that is open already, or came earlier in this run, is skipped and counted.
    """
    pooled = candidates[0]
    for c in candidates[1:]:
        pooled = pooled.unionByName(c)
    # A few rows with a long history, used several times below.
    pooled = cut_lineage(pooled)
    own = pooled.filter("entity_type = 'session'").select(
        "*", F.col("entity_id").alias("session_id"), F.lit(None).cast("string").alias("message_id"),
        F.lit(None).cast("string").alias("excerpt"),
    )
    linked = _anchored(pooled.filter("entity_type <> 'session'"), evidence)
    ready = linked.unionByName(own)
    taken = existing.filter(OPEN).select("title").distinct().withColumn("open_before", F.lit(True))
    first = Window.partitionBy("title").orderBy("generator", "place")
    judged = (
        ready.withColumn("turn", F.row_number().over(first))
        .join(taken, "title", "left")
        .withColumn("created", F.col("open_before").isNull() & (F.col("turn") == 1))
    )
    new = judged.filter("created").withColumn("id", make_id("recommendation", F.col("title"), as_of))
    links = new.select(
        make_id("evidence", F.lit("recommendation"), F.col("id"), F.col("session_id")).alias("id"),
        F.lit("recommendation").alias("entity_type"), F.col("id").alias("entity_id"), "session_id", "message_id",
        "excerpt",
        F.concat(F.lit("Auto-generated "), F.col("recommendation_type"), F.lit(" recommendation.")).alias("explanation"),
        F.col("grounding_score").alias("evidence_score"), as_of.alias("created_at"),
    )
    counts = judged.agg(
        F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("skipped_duplicate")
    )
    return Generated(
        conform(new.withColumn("created_at", as_of), "recommendations"), conform(links, "evidence_links"), counts
    )


def seed_recommendation(
    recommendations: DataFrame, projects: DataFrame, evidence: DataFrame, sessions: DataFrame, messages: DataFrame,
    as_of: Column,
) -> Generated:
    """One first recommendation, when live projects exist and no recommendation ever did.

    Anchored to the newest project's newest evidence, else to the newest session's first user message.
    """
    live = projects.filter("status <> 'archived'")
    newest_project = live.orderBy(F.desc("last_seen_at"), "id").limit(1).select(F.col("id").alias("project_id"))
    any_before = recommendations.agg(F.count("*")).scalar()
    due = newest_project.withColumn("n", any_before).filter("n = 0").drop("n").withColumn("one", F.lit(1))
    anchor = latest_evidence(evidence, "project", newest_project.select(F.col("project_id").alias("id"))).select(
        F.col("entity_id").alias("project_id"), F.struct("session_id", "message_id", "excerpt").alias("anchor")
    )
    newest_session = (
        sessions.select("id", session_time().alias("at")).orderBy(F.desc("at"), "id").limit(1)
        .select(F.col("id").alias("session_id"))
    )
    said = messages.filter("role = 'user'").join(newest_session, "session_id", "left_semi").groupBy("session_id").agg(
        F.min_by(F.struct("id", F.substring("content_text", 1, SEED_EXCERPT_CHARS).alias("excerpt")), "sort_order").alias("u")
    )
    fallback = newest_session.join(said, "session_id", "left").select(
        F.lit(1).alias("one"),
        F.struct("session_id", F.col("u.id").alias("message_id"), F.col("u.excerpt").alias("excerpt")).alias("fallback"),
    )
    rows = (
        due.join(anchor, "project_id", "left").join(fallback, "one", "left")
        .select(F.coalesce("anchor", "fallback").alias("a")).filter("a is not null")
        .select("a.*", make_id("recommendation", F.lit(SEED_TITLE), as_of).alias("rec_id"))
    )
    recs = rows.select(
        F.col("rec_id").alias("id"), F.lit(SEED_TITLE).alias("title"), F.lit(SEED_RATIONALE).alias("rationale"),
        F.lit("next_action").alias("recommendation_type"), F.lit(0.55).alias("priority_score"),
        F.lit(0.7).alias("actionability_score"), F.lit(0.45).alias("grounding_score"), as_of.alias("created_at"),
    )
    links = rows.select(
        make_id("evidence", F.lit("recommendation"), F.col("rec_id"), F.col("session_id")).alias("id"),
        F.lit("recommendation").alias("entity_type"), F.col("rec_id").alias("entity_id"), "session_id", "message_id",
        "excerpt", F.lit(SEED_EXPLANATION).alias("explanation"), F.lit(0.45).alias("evidence_score"),
        as_of.alias("created_at"),
    )
    counts = recs.agg(F.count("*").alias("created")).withColumn("skipped_duplicate", F.lit(0).cast("bigint"))
    return Generated(conform(recs, "recommendations"), conform(links, "evidence_links"), counts)


def open_recommendations(recommendations: DataFrame) -> DataFrame:
    return recommendations.filter(OPEN).orderBy(F.desc("priority_score"), F.desc("created_at"), "id")


def recommendations_by_section(recommendations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Open recommendations in their six fixed sections, one row per link; an empty section keeps one row."""
    spark = recommendations.sparkSession
    links = evidence.filter("entity_type = 'recommendation'").select(
        F.col("entity_id").alias("id"), "session_id", "message_id", "excerpt",
        F.col("created_at").alias("evidence_at"),
    )
    kind = F.col("recommendation_type")
    number, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, shown) in enumerate(SECTIONS):
        number, title = F.when(kind == name, i).otherwise(number), F.when(kind == name, shown).otherwise(title)
    listed = recommendations.filter(OPEN).join(links, "id", "left")
    listed = listed.withColumn("section_no", number).withColumn("section", title).filter("section_no IS NOT NULL")
    # The sections in use are at most six rows; the others keep one row each.
    used = recommendations.filter(OPEN).select("recommendation_type").distinct()
    rows = [(i, name, shown) for i, (name, shown) in enumerate(SECTIONS)]
    sections = spark.createDataFrame(rows, "section_no int, recommendation_type string, section string")
    empty = sections.join(used, "recommendation_type", "left_anti")
    return listed.unionByName(empty, allowMissingColumns=True).orderBy(
        "section_no", F.desc("priority_score"), F.desc("created_at"), "id", F.desc("evidence_at")
    )


def apply_actions(recommendations: DataFrame, actions: DataFrame) -> DataFrame:
    """Stamp accepted and dismissed times from actions (id, action, at); a later action replaces the time."""
    at = {a: F.max(F.when(F.col("action") == a, F.col("at"))).alias(f"_{a}") for a in ("accept", "dismiss")}
    stamps = actions.groupBy("id").agg(*at.values())
    stamped = (
        recommendations.join(stamps, "id", "left")
        .withColumn("accepted_at", F.coalesce("_accept", "accepted_at"))
        .withColumn("dismissed_at", F.coalesce("_dismiss", "dismissed_at"))
    )
    return conform(stamped, "recommendations")


