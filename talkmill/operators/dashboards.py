"""Totals, trends, listings and detail views."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import days_between_truncated, round_half_up, session_time

# Activity levels, trend spans and listing limits.
HOT_DAYS, HOT_MOMENTUM = 7, 0.5
WARM_DAYS, WARM_MOMENTUM = 30, 0.2
UNKNOWN_DAYS = 999
TREND_DAYS = 14

OPEN = "dismissed_at IS NULL AND accepted_at IS NULL"


def library_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Nine totals in one row. Each table is counted on its own and the counts are unioned, not joined."""
    counted = {
        "session_count": tables["sessions"],
        "message_count": tables["messages"],
        "artifact_count": tables["artifacts"],
        "chunk_count": tables["chunks"],
        "completed_import_count": tables["import_batches"].filter("status = 'completed'"),
        "source_count": tables["sources"],
        "project_count": tables["projects"].filter("status <> 'archived'"),
        "theme_count": tables["themes"],
        "open_recommendations_count": tables["recommendations"].filter(OPEN),
    }
    rows = None
    for name, df in counted.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in counted])


def activity_trend(sessions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sessions per day, from ``days`` before as_of on."""
    day = F.to_date(session_time())
    recent = sessions.select(day.alias("day")).filter(F.col("day") >= F.date_sub(F.to_date(as_of), days))
    return recent.groupBy("day").agg(F.count("*").alias("count")).orderBy("day")


def activity_series(sessions: DataFrame, as_of: date, days: int) -> DataFrame:
    """The last ``days`` days ending with as_of, zero-filled, each with the total of the trend."""
    start = as_of - timedelta(days=days - 1)
    trend = activity_trend(sessions, F.lit(as_of), days)
    series = sessions.sparkSession.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    total = trend.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    return (
        series.join(trend, "day", "left")
        .select("day", F.coalesce("count", F.lit(0)).alias("count"))
        .withColumn("total", total)
        .orderBy("day")
    )


def _typed_sessions(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    kinds = sources.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"))
    return sessions.join(kinds, "source_id")


def source_distribution(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Sessions per source type, with their share of all sessions in percent.

    Sessions are counted per source before the join, so a source with most of the rows costs nothing extra.
    """
    per_source = sessions.groupBy("source_id").agg(F.count("*").alias("n"))
    counts = _typed_sessions(per_source, sources).groupBy("source_type").agg(F.sum("n").alias("count"))
    everything = sessions.agg(F.count("*")).scalar()
    return (
        counts.withColumn("total", everything)
        .select("source_type", "count", round_half_up(F.col("count") * 100 / F.col("total")).cast("bigint").alias("percent"))
        .orderBy(F.desc("count"), "source_type")
    )


def recent_sessions(sessions: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    rows = _typed_sessions(sessions.select("id", "source_id", "title", "started_at", "created_at"), sources)
    return rows.drop("source_id").orderBy(F.desc("created_at"), "id").limit(limit)


def timeline(
    sessions: DataFrame,
    sources: DataFrame,
    source_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sessions with optional source and date range; with a limit, the newest ones. The reader orders what it shows."""
    rows = _typed_sessions(sessions, sources).withColumn("at", session_time())
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    if date_from:
        rows = rows.filter(F.to_date("at") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.filter(F.to_date("at") <= F.lit(date_to).cast("date"))
    return rows if limit is None else rows.orderBy(F.desc("at"), "id").limit(limit)


def timeline_days(listed: DataFrame) -> DataFrame:
    """Days of a timeline with their counts and density relative to the busiest day."""
    days = listed.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("count"))
    busiest = days.agg(F.greatest(F.max("count"), F.lit(1))).scalar()
    return days.withColumn("max_count", busiest).select(
        "day", "count", (F.col("count") / F.col("max_count")).alias("density")
    ).orderBy(F.desc("day"))


def timeline_tags(listed: DataFrame, intelligence: DataFrame, newest: int | None = None) -> DataFrame:
    """The first linked project of each session, or of the newest ones."""
    top = listed if newest is None else listed.orderBy(F.desc("at"), "id").limit(newest)
    top = top.select(F.col("id").alias("session_id"), "at")
    projects = intelligence.filter("entity_type = 'project'")
    tags = top.join(projects, "session_id").groupBy("session_id").agg(
        F.min_by("label", "entity_id").alias("project_tag")
    )
    return top.join(tags, "session_id", "left").select("session_id", "at", "project_tag")


def evidence_totals(evidence: DataFrame, entity_type: str, *extra: Column) -> DataFrame:
    """entity_id, evidence_count, session_count and sums of ``extra``.

    Two steps: rows are first combined per (entity, session), which spreads an entity with very many links
    over all tasks; then those few rows are counted. Evidence ids are unique, so they need no distinct.
    """
    links = evidence.filter(F.col("entity_type") == entity_type)
    per_session = links.groupBy("entity_id", "session_id").agg(F.count("*").alias("n"), *extra)
    sums = [F.sum(c).alias(c) for c in per_session.columns[3:]]
    return per_session.groupBy("entity_id").agg(
        F.sum("n").alias("evidence_count"), F.count("session_id").alias("session_count"), *sums
    )


def project_activity(
    projects: DataFrame, evidence: DataFrame, as_of: Column, include_archived: bool = False
) -> DataFrame:
    """Projects with evidence and session counts, days since the last activity, and a level."""
    if not include_archived:
        projects = projects.filter("status <> 'archived'")
    totals = evidence_totals(evidence, "project").withColumnRenamed("entity_id", "id")
    days = F.coalesce(days_between_truncated(as_of, F.col("last_seen_at")), F.lit(UNKNOWN_DAYS))
    momentum = F.coalesce("momentum_score", F.lit(0.0))
    level = (
        F.when((F.col("days_since_last_activity") <= HOT_DAYS) | (momentum > HOT_MOMENTUM), "hot")
        .when((F.col("days_since_last_activity") <= WARM_DAYS) | (momentum > WARM_MOMENTUM), "warm")
        .otherwise("cold")
    )
    return (
        projects.join(totals, "id", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
        .withColumn("session_count", F.coalesce("session_count", F.lit(0)))
        .withColumn("days_since_last_activity", days)
        .withColumn("activity_level", level)
    )


def top_active_projects(activity: DataFrame, limit: int) -> DataFrame:
    boost = F.when(F.col("activity_level") == "hot", 1.0).when(F.col("activity_level") == "warm", 0.5).otherwise(0.0)
    scored = activity.filter("status <> 'archived'").withColumn(
        "activity_score", F.coalesce("momentum_score", F.lit(0.0)) + boost
    )
    return scored.orderBy(F.desc("activity_score"), F.desc("last_seen_at"), "id").limit(limit)


def project_list(activity: DataFrame, status: str | None = None, order: str = "recent") -> DataFrame:
    """Projects of one status (None for all), ordered by recent, sessions or name."""
    if status:
        activity = activity.filter(F.col("status") == status)
    orders = {
        "recent": [F.desc("last_seen_at"), F.col("id")],
        "sessions": [F.desc("session_count"), F.desc("last_seen_at"), F.col("id")],
        "name": [F.lower("canonical_title"), F.col("id")],
    }
    return activity.orderBy(*orders[order])


def theme_recurrence(themes: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Themes with distinct sessions, links of the last 14 calendar days and of the 14 before, and the trend."""
    day = F.to_date("created_at")
    recent_from = F.date_sub(F.to_date(as_of), TREND_DAYS)
    prior_from = F.date_sub(F.to_date(as_of), 2 * TREND_DAYS)
    totals = evidence_totals(
        evidence, "theme",
        F.count_if(day >= recent_from).alias("recent_count"),
        F.count_if((day < recent_from) & (day >= prior_from)).alias("prior_count"),
    ).withColumnRenamed("entity_id", "id")
    counts = ["session_count", "recent_count", "prior_count"]
    rows = themes.join(totals.drop("evidence_count"), "id", "left")
    for c in counts:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    trend = (
        F.when(F.col("recent_count") > F.col("prior_count") + 1, "rising")
        .when(F.col("prior_count") > F.col("recent_count") + 1, "declining")
        .otherwise("stable")
    )
    return rows.withColumn("trend", trend)


def theme_list(recurrence: DataFrame, order: str = "sessions", limit: int | None = None) -> DataFrame:
    orders = {
        "sessions": [F.desc("session_count"), F.desc("last_seen_at"), F.col("id")],
        "recent": [F.desc("last_seen_at"), F.col("id")],
        "name": [F.lower("label"), F.col("id")],
    }
    rows = recurrence.orderBy(*orders[order])
    return rows if limit is None else rows.limit(limit)


def session_intelligence(evidence: DataFrame, projects: DataFrame, themes: DataFrame) -> DataFrame:
    """Distinct (session, entity) links to live projects and to themes, for all sessions.

    Links are made distinct before the join, so entity rows meet each session once.
    """
    links = (
        evidence.filter(F.col("entity_type").isin("project", "theme"))
        .select("session_id", "entity_type", "entity_id")
        .distinct()
    )
    named = (
        projects.filter("status <> 'archived'")
        .select(F.lit("project").alias("entity_type"), F.col("id").alias("entity_id"), F.col("canonical_title").alias("label"))
        .unionByName(themes.select(F.lit("theme").alias("entity_type"), F.col("id").alias("entity_id"), "label"))
    )
    return links.join(named, ["entity_type", "entity_id"]).select("session_id", "entity_type", "entity_id", "label")


def session_detail(sessions: DataFrame, messages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Reading view, one row per message and per artifact: artifacts follow their message, orphans come last.

    Rows stay flat, so a very long session is no single record. Filter ``sessions`` for one session.
    """
    ids = sessions.select(F.col("id").alias("session_id"))
    none = F.lit(None).cast("string")
    said = messages.select(
        "session_id", F.lit("message").alias("part"), F.col("sort_order"), F.col("id").alias("message_id"),
        none.alias("artifact_id"), "role", "content_text",
    )
    places = messages.select(F.col("id").alias("message_id"), "session_id", "sort_order")
    attached = artifacts.filter(F.col("message_id").isNotNull()).join(places, ["message_id", "session_id"]).select(
        "session_id", F.lit("artifact").alias("part"), "sort_order", "message_id", F.col("id").alias("artifact_id"),
        none.alias("role"), "content_text",
    )
    orphans = artifacts.filter(F.col("message_id").isNull()).select(
        "session_id", F.lit("orphan_artifact").alias("part"), F.lit(None).cast("int").alias("sort_order"),
        none.alias("message_id"), F.col("id").alias("artifact_id"), none.alias("role"), "content_text",
    )
    return said.unionByName(attached).unionByName(orphans).join(ids, "session_id", "left_semi")
