"""Queries of session metrics, dashboards and provenance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.stopwords import STOPWORDS
from talkmill.operators import analytics as an
from talkmill.operators import dashboards as da
from talkmill.operators import provenance as pr
from talkmill.plans.oracle_views import sql_round, sql_time, sql_words, with_views
from talkmill.plans.registry import query
from talkmill.plans.testbed import Testbed, as_of
from talkmill.schema import empty_table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


METRICS = f"""
    SELECT s.id AS session_id, count(m.id) AS message_count,
           count(m.id) FILTER (m.role = 'user') AS user_msg_count,
           count(m.id) FILTER (m.role = 'assistant') AS assistant_msg_count,
           coalesce(sum(len({sql_words('m.content_text')})), 0)::bigint AS word_count,
           CASE WHEN count(m.id) >= 2 AND max(m.ts) > min(m.ts)
                THEN floor((epoch_ms(arg_max(m.ts, m.sort_order)) - epoch_ms(arg_min(m.ts, m.sort_order))) / 60000.0 * 10 + 0.5)::double / 10
           END AS duration_minutes
    FROM v_sessions s LEFT JOIN v_messages m ON m.session_id = s.id GROUP BY s.id"""


def keywords_sql(messages: str) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
    return f"""
    SELECT session_id, string_agg(word, ',' ORDER BY rn) AS top_keywords FROM (
      SELECT session_id, word, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, so, p) AS rn FROM (
        SELECT session_id, word, count(*) AS n, min(so * 10000000 + pos) // 10000000 AS so, min(so * 10000000 + pos) % 10000000 AS p
        FROM (SELECT session_id, sort_order::hugeint AS so, unnest(w) AS word, generate_subscripts(w, 1) AS pos
              FROM (SELECT session_id, sort_order, regexp_extract_all(lower(content_text), '[a-z0-9''-]+') AS w FROM {messages}))
        WHERE length(word) > 2 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({stop})
        GROUP BY session_id, word))
    WHERE rn <= 15 GROUP BY session_id"""


@query("session_metrics", with_views(METRICS))
def session_metrics(t: Testbed) -> DataFrame:
    return an.session_metrics(t.sessions, t.messages)


@query("session_keywords", lambda: with_views(keywords_sql("v_all_messages")))
def session_keywords(t: Testbed) -> DataFrame:
    return an.top_keywords(t.all_messages)


@query(
    "session_analytics_update",
    lambda: with_views(
        f"""SELECT a.session_id,
               CASE WHEN a.session_id::bigint % 2 = 0 THEN -1 ELSE word_count END AS word_count,
               CASE WHEN a.session_id::bigint % 2 = 0 THEN '' ELSE coalesce(top_keywords, '') END AS top_keywords,
               CASE WHEN a.session_id::bigint % 2 = 0 THEN 0 ELSE message_count END AS message_count
            FROM ({METRICS}) a LEFT JOIN ({keywords_sql('v_messages')}) k USING (session_id)"""
    ),
)
def session_analytics_update(t: Testbed) -> DataFrame:
    """Rows that exist stay as they are; the others are computed."""
    none = F.array().cast("array<string>")
    existing = t.sessions.filter(F.col("id").cast("bigint") % 2 == 0).select(
        F.col("id").alias("session_id"), F.lit(0).alias("message_count"), F.lit(-1).alias("word_count"),
        none.alias("top_keywords"),
    )
    out = an.update_session_analytics(existing, t.sessions, t.messages, as_of())
    return out.select("session_id", "word_count", "top_keywords", "message_count")


@query(
    "library_stats",
    with_views(
        """SELECT (SELECT count(*) FROM v_sessions) AS session_count, (SELECT count(*) FROM v_messages) AS message_count,
               (SELECT count(*) FROM v_artifacts) AS artifact_count, (SELECT count(*) FROM v_chunks) AS chunk_count,
               (SELECT count(*) FROM v_batches WHERE status = 'completed') AS completed_import_count,
               (SELECT count(*) FROM v_sources) AS source_count,
               (SELECT count(*) FROM v_projects WHERE status <> 'archived') AS project_count,
               (SELECT count(*) FROM v_themes) AS theme_count, 0::bigint AS open_recommendations_count"""
    ),
)
def library_stats(t: Testbed) -> DataFrame:
    return da.library_stats({
        "sessions": t.sessions, "messages": t.messages, "artifacts": t.artifacts, "chunks": t.chunks,
        "import_batches": t.batches, "sources": t.sources, "projects": t.projects, "themes": t.themes,
        "recommendations": empty_table(t.spark, "recommendations"),
    })


@query(
    "activity_trend",
    with_views(
        f"""SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS count
            FROM (SELECT coalesce(started_at, created_at)::date AS d FROM v_event_sessions)
            WHERE d >= {NOW}::date - 14 GROUP BY d"""
    ),
)
def activity_trend(t: Testbed) -> DataFrame:
    return da.activity_trend(t.event_sessions, as_of(), 14)


@query(
    "activity_series",
    with_views(
        f"""WITH trend AS (SELECT d, count(*) AS n FROM (SELECT coalesce(started_at, created_at)::date AS d FROM v_event_sessions)
                           WHERE d >= {NOW}::date - 45 GROUP BY d),
            days AS (SELECT unnest(generate_series({NOW}::date - 44, {NOW}::date, INTERVAL 1 DAY))::date AS d)
            SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS count, (SELECT sum(n) FROM trend)::bigint AS total
            FROM days LEFT JOIN trend USING (d)"""
    ),
)
def activity_series(t: Testbed) -> DataFrame:
    return da.activity_series(t.event_sessions, date(2024, 1, 31), 45)


@query(
    "source_distribution",
    with_views(
        """SELECT type AS source_type, count(*) AS count,
               floor(count(*) * 100 / (SELECT count(*) FROM v_event_sessions) + 0.5)::bigint AS percent
           FROM v_event_sessions s JOIN v_sources src ON src.id = s.source_id GROUP BY type"""
    ),
)
def source_distribution(t: Testbed) -> DataFrame:
    return da.source_distribution(t.event_sessions, t.sources)


@query(
    "recent_sessions",
    with_views(
        f"""SELECT s.id, title, {sql_time('started_at')} AS started_at, {sql_time('created_at')} AS created_at, type AS source_type
            FROM v_sessions s JOIN v_sources src ON src.id = s.source_id ORDER BY s.created_at DESC, s.id LIMIT 20"""
    ),
)
def recent_sessions(t: Testbed) -> DataFrame:
    return da.recent_sessions(t.sessions, t.sources, 20)


def timeline_sql(where: str = "true", sessions: str = "v_event_sessions") -> str:
    return f"""SELECT s.id, title, type AS source_type, coalesce(started_at, created_at) AS at_time
               FROM {sessions} s JOIN v_sources src ON src.id = s.source_id WHERE {where}"""


TIMELINE_WHERE = (
    "type = 'claude' AND coalesce(started_at, created_at)::date BETWEEN date '2024-01-05' AND date '2024-01-20'"
)


@query("timeline", with_views(f"SELECT id, title, source_type, {sql_time('at_time')} AS at_time FROM ({timeline_sql(TIMELINE_WHERE)})"))
def timeline(t: Testbed) -> DataFrame:
    rows = da.timeline(t.event_sessions, t.sources, "claude", "2024-01-05", "2024-01-20")
    return rows.select("id", "title", "source_type", F.col("at").alias("at_time"))


@query(
    "timeline_days",
    with_views(
        f"""WITH d AS (SELECT at_time::date AS day, count(*) AS n FROM ({timeline_sql()}) GROUP BY 1)
            SELECT strftime(day, '%Y-%m-%d') AS day, n AS count, {sql_round('n / (SELECT max(n) FROM d)')} AS density FROM d"""
    ),
)
def timeline_days(t: Testbed) -> DataFrame:
    return da.timeline_days(da.timeline(t.event_sessions, t.sources))


INTELLIGENCE = """
    SELECT DISTINCT e.session_id, e.entity_type, e.entity_id, coalesce(p.canonical_title, th.label) AS label
    FROM v_evidence e
    LEFT JOIN v_projects p ON e.entity_type = 'project' AND p.id = e.entity_id AND p.status <> 'archived'
    LEFT JOIN v_themes th ON e.entity_type = 'theme' AND th.id = e.entity_id
    WHERE p.id IS NOT NULL OR th.id IS NOT NULL"""


@query(
    "timeline_tags",
    with_views(
        f"""SELECT t.id AS session_id, {sql_time('t.at_time')} AS at_time, arg_min(i.label, i.entity_id) AS project_tag
            FROM ({timeline_sql(sessions='v_sessions')}) t
            LEFT JOIN ({INTELLIGENCE}) i ON i.session_id = t.id AND i.entity_type = 'project' GROUP BY t.id, t.at_time"""
    ),
)
def timeline_tags(t: Testbed) -> DataFrame:
    listed = da.timeline(t.sessions, t.sources)
    tags = da.timeline_tags(listed, da.session_intelligence(t.evidence, t.projects, t.themes))
    return tags.withColumnRenamed("at", "at_time")


def activity_sql(projects: str = "v_projects") -> str:
    return f"""
    SELECT *, CASE WHEN days_since_last_activity <= 7 OR momentum_score > 0.5 THEN 'hot'
                   WHEN days_since_last_activity <= 30 OR momentum_score > 0.2 THEN 'warm' ELSE 'cold' END AS activity_level
    FROM (SELECT p.*, count(DISTINCT e.id) AS evidence_count, count(DISTINCT e.session_id) AS session_count,
                 trunc((epoch_us({NOW}) - epoch_us(p.last_seen_at)) / 86400000000)::bigint AS days_since_last_activity
          FROM {projects} p LEFT JOIN v_evidence e ON e.entity_type = 'project' AND e.entity_id = p.id
          WHERE p.status <> 'archived' GROUP BY ALL)"""


ACTIVITY_COLS = ["id", "canonical_title", "evidence_count", "session_count", "days_since_last_activity", "activity_level"]


@query("project_activity", with_views(f"SELECT {', '.join(ACTIVITY_COLS)} FROM ({activity_sql()})"))
def project_activity(t: Testbed) -> DataFrame:
    return da.project_activity(t.projects, t.evidence, as_of()).select(*ACTIVITY_COLS)


@query(
    "top_active_projects",
    with_views(
        f"""SELECT id, {sql_round('s')} AS activity_score, {sql_time('last_seen_at')} AS last_seen_at FROM (
              SELECT *, coalesce(momentum_score, 0) + CASE activity_level WHEN 'hot' THEN 1 WHEN 'warm' THEN 0.5 ELSE 0 END AS s
              FROM ({activity_sql()})) ORDER BY s DESC, last_seen_at DESC, id LIMIT 10"""
    ),
)
def top_active_projects(t: Testbed) -> DataFrame:
    top = da.top_active_projects(da.project_activity(t.projects, t.evidence, as_of()), 10)
    return top.select("id", "activity_score", "last_seen_at")


@query(
    "project_list",
    with_views(
        f"""SELECT id, canonical_title, row_number() OVER (ORDER BY session_count DESC, last_seen_at DESC, id) AS place
            FROM ({activity_sql()}) WHERE status = 'speculative'"""
    ),
)
def project_list(t: Testbed) -> DataFrame:
    from talkmill.operators.profile import numbered

    activity = da.project_activity(t.projects, t.evidence, as_of())
    listed = da.project_list(activity, "speculative", "sessions")
    order = [F.desc("session_count"), F.desc("last_seen_at"), F.col("id")]
    return numbered(listed, order, "n").select("id", "canonical_title", (F.col("n") + 1).alias("place"))


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their place in an order, for listings whose order is the result."""
    from talkmill.operators.profile import numbered

    return numbered(rows, order, "n").withColumn("place", F.col("n") + 1)


PROJECT_ORDERS = {"recent": "last_seen_at DESC, id", "name": "lower(canonical_title), id"}
for _order, _sql in PROJECT_ORDERS.items():

    @query(
        f"project_list_{_order}",
        with_views(f"SELECT id, canonical_title, row_number() OVER (ORDER BY {_sql}) AS place FROM ({activity_sql()})"),
    )
    def project_list_by(t: Testbed, order: str = _order) -> DataFrame:
        listed = da.project_list(da.project_activity(t.projects, t.evidence, as_of()), order=order)
        keys = [F.desc("last_seen_at"), F.col("id")] if order == "recent" else [F.lower("canonical_title"), F.col("id")]
        return _placed(listed, keys).select("id", "canonical_title", "place")


RECURRENCE = f"""
    SELECT *, CASE WHEN recent_count > prior_count + 1 THEN 'rising' WHEN prior_count > recent_count + 1 THEN 'declining'
                   ELSE 'stable' END AS trend
    FROM (SELECT t.id, t.label, t.last_seen_at, count(DISTINCT e.session_id) AS session_count,
                 count(*) FILTER (e.created_at::date >= {NOW}::date - 14) AS recent_count,
                 count(*) FILTER (e.created_at::date < {NOW}::date - 14 AND e.created_at::date >= {NOW}::date - 28) AS prior_count
          FROM v_themes t LEFT JOIN v_evidence e ON e.entity_type = 'theme' AND e.entity_id = t.id GROUP BY ALL)"""


@query("theme_recurrence", with_views(f"SELECT id, session_count, recent_count, prior_count, trend FROM ({RECURRENCE})"))
def theme_recurrence(t: Testbed) -> DataFrame:
    rows = da.theme_recurrence(t.themes, t.evidence, as_of())
    return rows.select("id", "session_count", "recent_count", "prior_count", "trend")


@query(
    "top_themes",
    with_views(f"SELECT id, label, session_count FROM ({RECURRENCE}) ORDER BY session_count DESC, last_seen_at DESC, id LIMIT 3"),
)
def top_themes(t: Testbed) -> DataFrame:
    return da.theme_list(da.theme_recurrence(t.themes, t.evidence, as_of()), limit=3).select("id", "label", "session_count")


THEME_ORDERS = {"recent": "last_seen_at DESC, id", "name": "lower(label), id"}
for _order, _sql in THEME_ORDERS.items():

    @query(
        f"theme_list_{_order}",
        with_views(f"SELECT id, label, row_number() OVER (ORDER BY {_sql}) AS place FROM ({RECURRENCE})"),
    )
    def theme_list_by(t: Testbed, order: str = _order) -> DataFrame:
        listed = da.theme_list(da.theme_recurrence(t.themes, t.evidence, as_of()), order)
        keys = [F.desc("last_seen_at"), F.col("id")] if order == "recent" else [F.lower("label"), F.col("id")]
        return _placed(listed, keys).select("id", "label", "place")


@query(
    "session_profiles_json",
    lambda: with_views(
        f"""SELECT session_id, message_count, word_count,
               CASE WHEN session_id::bigint % 7 = 0 THEN '' ELSE coalesce(top_keywords, '') END AS top_keywords
            FROM ({METRICS}) m LEFT JOIN ({keywords_sql('v_messages')}) k USING (session_id)"""
    ),
)
def session_profiles_json(t: Testbed) -> DataFrame:
    """Profiles read from keywords that are stored as JSON text, some of it damaged."""
    rows = an.compute_session_analytics(t.sessions, t.messages, as_of())
    text = F.to_json(F.coalesce("top_keywords", F.array().cast("array<string>")))
    damaged = F.when(F.col("session_id").cast("bigint") % 7 == 0, F.concat(F.lit("["), text)).otherwise(text)
    stored = rows.withColumn("top_keywords_json", damaged).drop("top_keywords")
    return an.session_profiles(stored).select("session_id", "message_count", "word_count", "top_keywords")


@query("session_intelligence", with_views(INTELLIGENCE))
def session_intelligence(t: Testbed) -> DataFrame:
    return da.session_intelligence(t.evidence, t.projects, t.themes)


@query(
    "session_detail",
    with_views(
        """SELECT 'message' AS part, m.session_id, m.id AS message_id, NULL AS artifact_id, m.sort_order, length(content_text)::bigint AS n_chars
           FROM v_messages m
           UNION ALL
           SELECT 'artifact', a.session_id, a.message_id, a.id, m.sort_order, length(a.content_text)
           FROM v_artifacts a JOIN v_messages m ON m.id = a.message_id AND m.session_id = a.session_id
           WHERE a.session_id IN (SELECT id FROM v_sessions)
           UNION ALL
           SELECT 'orphan_artifact', session_id, NULL, id, NULL, length(content_text) FROM v_artifacts
           WHERE message_id IS NULL AND session_id IN (SELECT id FROM v_sessions)"""
    ),
)
def session_detail(t: Testbed) -> DataFrame:
    rows = da.session_detail(t.sessions, t.messages, t.artifacts)
    return rows.select("part", "session_id", "message_id", "artifact_id", "sort_order", F.length("content_text").alias("n_chars"))


@query(
    "evidence_of_entities",
    with_views(
        f"""SELECT id, entity_id, session_id, {sql_time('created_at')} AS created_at FROM v_evidence
            WHERE entity_type = 'project' AND entity_id IN (SELECT id FROM v_projects WHERE status = 'archived')"""
    ),
)
def evidence_of_entities(t: Testbed) -> DataFrame:
    rows = pr.evidence_for(t.evidence, "project", t.projects.filter("status = 'archived'"))
    return rows.select("id", "entity_id", "session_id", "created_at")


@query(
    "evidence_of_sessions",
    with_views("SELECT id, entity_type, session_id FROM v_evidence WHERE session_id IN (SELECT id FROM v_sessions WHERE title = 'Topic 3')"),
)
def evidence_of_sessions(t: Testbed) -> DataFrame:
    rows = pr.evidence_of_sessions(t.evidence, t.sessions.filter("title = 'Topic 3'"))
    return rows.select("id", "entity_type", "session_id")


@query(
    "sessions_by_evidence",
    with_views(
        """SELECT id, id IN (SELECT session_id FROM v_evidence WHERE entity_type = 'theme') AS has_theme FROM v_sessions"""
    ),
)
def sessions_by_evidence(t: Testbed) -> DataFrame:
    have = pr.sessions_with_evidence(t.sessions, t.evidence, "theme").select("id", F.lit(True).alias("has_theme"))
    lack = pr.sessions_missing_evidence(t.sessions, t.evidence, "theme").select("id", F.lit(False).alias("has_theme"))
    return have.unionByName(lack)


@query(
    "entity_detail",
    with_views(
        f"""SELECT p.id AS entity_id, p.canonical_title AS label, e.session_id, count(*) AS link_count,
                   {sql_time('max(e.created_at)')} AS newest_link_at, s.title AS session_title
            FROM v_projects p JOIN v_evidence e ON e.entity_type = 'project' AND e.entity_id = p.id
            LEFT JOIN v_sessions s ON s.id = e.session_id GROUP BY ALL"""
    ),
)
def entity_detail(t: Testbed) -> DataFrame:
    return pr.entity_detail(t.projects, "project", "canonical_title", t.evidence, t.sessions)


@query(
    "provenance_audit",
    with_views(
        """SELECT 'entity_without_evidence' AS problem, 'project' AS entity_type, id AS ref_id FROM v_merge_input
           WHERE id NOT IN (SELECT entity_id FROM v_evidence WHERE entity_type = 'project')
           UNION ALL
           SELECT DISTINCT 'missing_entity', 'project', entity_id FROM v_evidence
           WHERE entity_type = 'project' AND entity_id NOT IN (SELECT id FROM v_merge_input)
           UNION ALL
           SELECT DISTINCT 'missing_session', entity_type, session_id FROM v_evidence WHERE session_id NOT IN (SELECT id FROM v_sessions)
           UNION ALL
           SELECT DISTINCT 'missing_message', entity_type, message_id FROM v_evidence WHERE message_id NOT IN (SELECT id FROM v_messages)"""
    ),
)
def provenance_audit(t: Testbed) -> DataFrame:
    return pr.provenance_audit(t.evidence, {"project": t.merge_input, "theme": t.themes}, t.sessions, t.messages)
