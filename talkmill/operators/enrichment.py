"""Status, momentum, recurrence and descriptions from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import days_between_floored
from talkmill.functions.text import strip_ws
from talkmill.schema import conform

# Spans, thresholds and texts of the enrichment.
RECENT_MILLIS = 14 * 86_400_000
STALLED_DAYS = 30
PROJECT_TITLE_SESSIONS, PROJECT_TITLES = 5, 3
THEME_TITLE_SESSIONS = 3
DASH = "—"


def _links(evidence: DataFrame, entity_type: str, sessions: DataFrame, as_of: Column) -> DataFrame:
    """One row per (entity, session): newest link, link counts by age, and the session's title and source.

    Combining per pair first spreads an entity, or a session, that has very many links.
    """
    age = F.unix_millis(as_of) - F.unix_millis("created_at")
    per_session = (
        evidence.filter(F.col("entity_type") == entity_type)
        .groupBy("entity_id", "session_id")
        .agg(
            F.max("created_at").alias("newest"),
            F.count_if(age < RECENT_MILLIS).alias("recent"),
            F.count_if((age >= RECENT_MILLIS) & (age < 2 * RECENT_MILLIS)).alias("prior"),
        )
    )
    known = sessions.select(F.col("id").alias("session_id"), "title", "source_id")
    return per_session.join(known, "session_id", "left")


def _totals(links: DataFrame) -> DataFrame:
    return links.groupBy("entity_id").agg(
        F.count("*").alias("session_count"),
        F.sum("recent").alias("recent"),
        F.sum("prior").alias("prior"),
        F.countDistinct("source_id").alias("source_span_count"),
    )


def _titles(links: DataFrame, newest: int) -> DataFrame:
    """Titles of each entity's newest sessions, in that order. Sessions without a title give none."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("newest"), "session_id")
    top = links.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= newest)
    named = top.filter(F.nullif("title", F.lit("")).isNotNull())
    listed = named.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", strip_ws(F.col("title")).alias("title")))).alias("t")
    )
    return listed.select("entity_id", F.col("t.title").alias("titles"))


def _with_links(entities: DataFrame, links: DataFrame, title_sessions: int, sessions: DataFrame) -> DataFrame:
    joined = (
        entities.join(_totals(links).withColumnRenamed("entity_id", "id"), "id", "left")
        .join(_titles(links, title_sessions).withColumnRenamed("entity_id", "id"), "id", "left")
        .withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
        .withColumn("total_sessions", sessions.agg(F.count("*")).scalar())
    )
    for c in ["session_count", "recent", "prior", "source_span_count"]:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    return joined


def enrich_projects(projects: DataFrame, evidence: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """All projects, with status, confidence, momentum, span and description set anew on those not archived."""
    live = projects.filter("status <> 'archived'").drop("source_span_count")
    links = _links(evidence, "project", sessions, as_of)
    n = F.col("session_count")
    idle = days_between_floored(as_of, F.col("last_seen_at"))
    stalled = (n >= 2) & (idle > STALLED_DAYS)
    titles = F.slice(F.array_distinct("titles"), 1, PROJECT_TITLES)
    rows = _with_links(live, links, PROJECT_TITLE_SESSIONS, sessions)
    out = rows.select(
        "id", "canonical_title", "next_action_summary", "first_seen_at", "last_seen_at",
        F.when(stalled, "stalled").when(n >= 2, "active").otherwise("speculative").alias("status"),
        F.when(stalled, F.greatest(F.col("confidence"), F.lit(0.5)))
        .when(n >= 2, F.least(F.lit(0.6) + n * F.lit(0.05), F.lit(0.9)))
        .otherwise(F.lit(0.35)).alias("confidence"),
        F.when(
            F.col("total_sessions") > 0, F.least(F.col("recent") / F.greatest(n, F.lit(1)), F.lit(1.0))
        ).otherwise(F.lit(0.0)).alias("momentum_score"),
        F.when(
            n >= 2,
            F.concat(F.lit("Work across "), n.cast("string"), F.lit(" sessions: "), F.array_join(titles, ", ")),
        ).when(
            (n == 1) & (F.size("titles") > 0), F.concat(F.lit("Single session: "), F.get("titles", F.lit(0)))
        ).alias("description"),
        "source_span_count",
    )
    return conform(out, "projects").unionByName(conform(projects.filter("status = 'archived'"), "projects"))


def enrich_themes(themes: DataFrame, evidence: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """All themes with recurrence, confidence and description set anew."""
    n = F.col("session_count")
    links = _links(evidence, "theme", sessions, as_of)
    rows = _with_links(themes, links, THEME_TITLE_SESSIONS, sessions)
    trend = (
        F.when(F.col("recent") > F.col("prior") + 1, "Rising")
        .when(F.col("prior") > F.col("recent") + 1, "Declining")
        .otherwise("Stable")
    )
    listed = F.when(F.size("titles") > 0, F.concat(F.lit(": "), F.array_join("titles", ", "))).otherwise(F.lit(""))
    out = rows.select(
        "id", "label", "first_seen_at", "last_seen_at",
        F.when(n >= 5, 0.75).when(n >= 3, 0.6).otherwise(0.35).alias("confidence"),
        F.when(F.col("total_sessions") > 0, F.least(n / F.col("total_sessions"), F.lit(1.0)))
        .otherwise(F.lit(0.0)).alias("recurrence_score"),
        F.concat(
            trend, F.lit(f" {DASH} appears in "),
            F.when(n >= 2, F.concat(n.cast("string"), F.lit(" sessions"), listed)).otherwise(F.lit("1 session")),
        ).alias("description"),
    )
    return conform(out, "themes")
