"""Queries of extraction, enrichment, merging, recommendations and the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators import analytics as an
from talkmill.operators import dashboards as da
from talkmill.operators import enrichment as en
from talkmill.operators import extraction as ex
from talkmill.operators import merging as me
from talkmill.operators import profile as pf
from talkmill.operators import recommendations as re
from talkmill.plans.oracle_views import sql_id, sql_round, sql_strip, sql_time, with_views
from talkmill.plans.queries_analytics import INTELLIGENCE, METRICS, NOW, RECURRENCE, keywords_sql
from talkmill.plans.registry import query
from talkmill.plans.testbed import AS_OF_REVISIT, Testbed, as_of
from talkmill.schema import conform, empty_table, make_id

# --- extraction -----------------------------------------------------------------------------------------

OPENINGS = f"""
    SELECT s.id AS session_id, s.title, s.started_at, s.created_at, s.updated_at,
           arg_min(m.id, m.sort_order) FILTER (m.role = 'user') AS message_id,
           arg_min(substring({sql_strip('m.content_text')}, 1, 120), m.sort_order) FILTER (m.role = 'user') AS label120,
           arg_min(substring(m.content_text, 1, 500), m.sort_order) FILTER (m.role = 'user') AS excerpt,
           arg_min(m.ts, m.sort_order) AS first_ts, arg_max(m.ts, m.sort_order) AS last_ts
    FROM v_sessions s LEFT JOIN v_messages m ON m.session_id = s.id GROUP BY ALL"""

PROJECTS = f"""
    SELECT session_id, {sql_id("'project'", 'session_id')} AS id, substring(coalesce(nullif({sql_strip('title')}, ''), nullif(label120, '')), 1, 500) AS canonical_title,
           coalesce(first_ts, started_at, {NOW}) AS first_seen_at, coalesce(last_ts, updated_at) AS last_seen_at, message_id, excerpt, started_at, created_at
    FROM ({OPENINGS}) WHERE message_id IS NOT NULL"""


@query(
    "project_candidates",
    with_views(
        f"""SELECT id, canonical_title, {sql_time('first_seen_at')} AS first_seen_at, {sql_time('last_seen_at')} AS last_seen_at,
               session_id, message_id, excerpt FROM ({PROJECTS})"""
    ),
)
def project_candidates(t: Testbed) -> DataFrame:
    found = ex.extract_projects(t.sessions, t.messages, None, as_of())
    links = found.evidence.select(F.col("entity_id").alias("id"), "session_id", "message_id", "excerpt")
    return found.projects.select("id", "canonical_title", "first_seen_at", "last_seen_at").join(links, "id")


@query(
    "missing_extraction",
    with_views(
        f"""SELECT session_id, canonical_title FROM ({PROJECTS}) p
            WHERE session_id NOT IN (SELECT session_id FROM v_evidence WHERE entity_type = 'project' AND event_id_mod)
            ORDER BY coalesce(started_at, created_at) DESC, session_id LIMIT 25""".replace(
            "AND event_id_mod", "AND entity_id IN (SELECT id FROM v_projects WHERE canonical_title LIKE 'red%')"
        )
    ),
)
def missing_extraction(t: Testbed) -> DataFrame:
    """Sessions without evidence for some projects, the newest 25 that yield a candidate."""
    red = t.projects.filter(F.col("canonical_title").startswith("red")).select(F.col("id").alias("entity_id"))
    links = t.evidence.join(red, "entity_id", "left_semi")
    found = ex.extract_missing(t.sessions, t.messages, None, links, as_of(), max_sessions=25)
    names = found.projects.select(F.col("id").alias("entity_id"), "canonical_title")
    return found.evidence.join(names, "entity_id").select("session_id", "canonical_title")


THEME_LABELS = f"""
    SELECT *, coalesce(nullif(substring({sql_strip('title')}, 1, 120), ''), nullif(label120, '')) AS label FROM ({OPENINGS})"""


@query(
    "theme_assignment",
    with_views(
        f"""SELECT session_id, label, CASE WHEN label = 'Topic 2' THEN 'known' ELSE {sql_id("'theme'", 'label')} END AS theme_id, message_id
            FROM ({THEME_LABELS}) WHERE label IS NOT NULL"""
    ),
)
def theme_assignment(t: Testbed) -> DataFrame:
    themes, links = ex.assign_themes(t.sessions, t.messages, _known_theme(t), empty_table(t.spark, "evidence_links"), as_of())
    names = themes.select(F.col("id").alias("entity_id"), "label").unionByName(_known_theme(t).select(F.col("id").alias("entity_id"), "label"))
    return links.join(names, "entity_id").select("session_id", "label", F.col("entity_id").alias("theme_id"), "message_id")


def _known_theme(t: Testbed) -> DataFrame:
    label = t.sessions.filter("title = 'Topic 2'").select(F.col("title").alias("label")).distinct()
    return conform(label.withColumn("id", F.lit("known")), "themes")


@query(
    "new_themes",
    with_views(
        f"""SELECT label, {sql_time('first_seen_at')} AS first_seen_at, {sql_time('last_seen_at')} AS last_seen_at FROM (
              SELECT label, coalesce(first_ts, started_at, {NOW}) AS first_seen_at, coalesce(last_ts, updated_at) AS last_seen_at,
                     row_number() OVER (PARTITION BY label ORDER BY coalesce(started_at, created_at) DESC, session_id) AS rn
              FROM ({THEME_LABELS}) WHERE label IS NOT NULL AND label <> 'Topic 2') WHERE rn = 1"""
    ),
)
def new_themes(t: Testbed) -> DataFrame:
    themes, _ = ex.assign_themes(t.sessions, t.messages, _known_theme(t), empty_table(t.spark, "evidence_links"), as_of())
    return themes.select("label", "first_seen_at", "last_seen_at")


# --- enrichment -----------------------------------------------------------------------------------------

AGE = f"(epoch_ms({NOW}) - epoch_ms(e.created_at))"


def links_sql(kind: str) -> str:
    return f"""
    SELECT e.entity_id, e.session_id, max(e.created_at) AS newest, count(*) FILTER ({AGE} < 1209600000) AS recent,
           count(*) FILTER ({AGE} >= 1209600000 AND {AGE} < 2419200000) AS prior, s.title, s.source_id
    FROM v_evidence e LEFT JOIN v_sessions s ON s.id = e.session_id WHERE e.entity_type = '{kind}' GROUP BY ALL"""


ENRICHED_PROJECTS = f"""
    SELECT p.id, p.canonical_title, p.first_seen_at, p.last_seen_at, n AS session_count, spans AS source_span_count,
           CASE WHEN n >= 2 AND idle > 30 THEN 'stalled' WHEN n >= 2 THEN 'active' ELSE 'speculative' END AS status,
           CASE WHEN n >= 2 AND idle > 30 THEN greatest(p.confidence, 0.5::double)
                WHEN n >= 2 THEN least(0.6::double + n * 0.05::double, 0.9::double) ELSE 0.35::double END AS confidence,
           least(recent / greatest(n, 1), 1)::double AS momentum_score,
           CASE WHEN n >= 2 THEN 'Work across ' || n || ' sessions: ' || coalesce(titles, '')
                WHEN n = 1 AND titles IS NOT NULL THEN 'Single session: ' || titles END AS description
    FROM (SELECT p.*, coalesce(a.n, 0) AS n, coalesce(a.recent, 0) AS recent, coalesce(a.spans, 0) AS spans, t.titles,
                 floor((epoch_ms({NOW}) - epoch_ms(p.last_seen_at)) / 86400000.0) AS idle
          FROM v_projects p
          LEFT JOIN (SELECT entity_id, count(*) AS n, sum(recent)::bigint AS recent, count(DISTINCT source_id) AS spans
                     FROM ({links_sql('project')}) GROUP BY entity_id) a ON a.entity_id = p.id
          LEFT JOIN (SELECT entity_id, string_agg(title, ', ' ORDER BY rn) AS titles FROM (
                       SELECT entity_id, title, min(rn) AS rn, row_number() OVER (PARTITION BY entity_id ORDER BY min(rn)) AS k FROM (
                         SELECT entity_id, title, row_number() OVER (PARTITION BY entity_id ORDER BY newest DESC, session_id) AS rn
                         FROM ({links_sql('project')})) WHERE rn <= 5 AND title IS NOT NULL GROUP BY entity_id, title)
                     WHERE k <= 3 GROUP BY entity_id) t ON t.entity_id = p.id
          WHERE p.status <> 'archived') p"""


@query(
    "project_enrichment",
    with_views(
        f"""SELECT id, status, {sql_round('confidence')} AS confidence, {sql_round('momentum_score')} AS momentum_score,
               source_span_count, description FROM ({ENRICHED_PROJECTS})
            UNION ALL SELECT id, status, 0.35::double, {sql_round('momentum_score')}, 1, NULL FROM v_projects WHERE status = 'archived'"""
    ),
)
def project_enrichment(t: Testbed) -> DataFrame:
    rows = en.enrich_projects(t.projects, t.evidence, t.sessions, as_of())
    return rows.select("id", "status", "confidence", "momentum_score", "source_span_count", "description")


@query(
    "theme_enrichment",
    with_views(
        f"""SELECT t.id, CASE WHEN n >= 5 THEN 0.75 WHEN n >= 3 THEN 0.6 ELSE 0.35 END::double AS confidence,
               {sql_round('least(n / (SELECT count(*) FROM v_sessions), 1)')} AS recurrence_score,
               CASE WHEN recent > prior + 1 THEN 'Rising' WHEN prior > recent + 1 THEN 'Declining' ELSE 'Stable' END || ' ' || chr(8212)
               || ' appears in ' || n || ' sessions' || coalesce(': ' || titles, '') AS description
            FROM v_themes t
            JOIN (SELECT entity_id, count(*) AS n, sum(recent) AS recent, sum(prior) AS prior FROM ({links_sql('theme')}) GROUP BY entity_id) a ON a.entity_id = t.id
            LEFT JOIN (SELECT entity_id, string_agg(title, ', ' ORDER BY rn) AS titles FROM (
                 SELECT entity_id, title, row_number() OVER (PARTITION BY entity_id ORDER BY newest DESC, session_id) AS rn FROM ({links_sql('theme')}))
                 WHERE rn <= 3 AND title IS NOT NULL GROUP BY entity_id) x ON x.entity_id = t.id"""
    ),
)
def theme_enrichment(t: Testbed) -> DataFrame:
    rows = en.enrich_themes(t.themes, t.evidence, t.sessions, as_of())
    return rows.select("id", "confidence", "recurrence_score", "description")


# --- merging --------------------------------------------------------------------------------------------

WORDS = "list_sort(list_distinct([w for w in regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+') if length(w) >= 2]))"


def pairs_sql(source: str) -> str:
    """All pairs with their scores."""
    return f"""
    SELECT *, CASE WHEN d IS NOT NULL THEN 0.5::double * ti + 0.25::double * d + 0.25::double * o
                   ELSE (0.5::double / 0.75::double) * ti + (0.25::double / 0.75::double) * o END AS score
    FROM (SELECT a.id AS project_a_id, b.id AS project_b_id,
             len(list_intersect(a.tw, b.tw))::double / (len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw))) AS ti,
             len(list_intersect(a.dw, b.dw))::double / (len(a.dw) + len(b.dw) - len(list_intersect(a.dw, b.dw))) AS d,
             CASE WHEN greatest(a.hi, b.hi) <= least(a.lo, b.lo) THEN 1::double
                  ELSE greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))::double / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) END AS o
          FROM features a JOIN features b ON a.id < b.id)""".replace(
        "features", f"""(SELECT id, {WORDS.format('canonical_title')} AS tw, {WORDS.format('description')} AS dw,
           epoch_ms(first_seen_at) AS lo, epoch_ms(last_seen_at) AS hi FROM {source})"""
    )


def best_pairs_sql(source: str, limit: int = 500) -> str:
    return f"SELECT * FROM ({pairs_sql(source)}) WHERE score >= 0.55 ORDER BY score DESC, project_a_id, project_b_id LIMIT {limit}"


PAIR_COLS = f"""project_a_id, project_b_id, {sql_round('score')} AS score_combined, {sql_round('ti')} AS score_title,
    {sql_round('d')} AS score_description, {sql_round('o')} AS score_temporal"""
LIVE = "(SELECT * FROM v_merge_input WHERE status <> 'archived')"


@query("merge_candidates", with_views(f"SELECT {PAIR_COLS} FROM ({best_pairs_sql('v_merge_input')})"))
def merge_candidates(t: Testbed) -> DataFrame:
    return me.merge_candidates(t.merge_input)


@query("merge_recompute", with_views(f"SELECT {PAIR_COLS} FROM ({best_pairs_sql(LIVE)})"))
def merge_recompute(t: Testbed) -> DataFrame:
    return me.recompute_candidates(t.merge_input, as_of()).drop("computed_at")


@query(
    "merge_candidate_list",
    with_views(
        f"""SELECT project_a_id, project_b_id, a.canonical_title AS title_a, b.canonical_title AS title_b, {sql_round('score')} AS score_combined
            FROM ({best_pairs_sql('v_merge_input')}) c
            JOIN v_merge_input a ON a.id = c.project_a_id AND a.status <> 'archived'
            JOIN v_merge_input b ON b.id = c.project_b_id AND b.status <> 'archived'"""
    ),
)
def merge_candidate_list(t: Testbed) -> DataFrame:
    listed = me.candidate_list(me.merge_candidates(t.merge_input), t.merge_input)
    return listed.select("project_a_id", "project_b_id", "title_a", "title_b", "score_combined")


ACCEPTED = """
    SELECT r.* FROM v_merge_requests r JOIN v_projects s ON s.id = r.surviving_project_id JOIN v_projects m ON m.id = r.merged_project_id
    WHERE s.status <> 'archived' AND m.status <> 'archived'"""
PLACE = "session_id, coalesce(message_id, '') AS message_key"


def _merged(t: Testbed) -> me.MergeResult:
    pairs = t.merge_requests.select(
        F.least("surviving_project_id", "merged_project_id").alias("project_a_id"),
        F.greatest("surviving_project_id", "merged_project_id").alias("project_b_id"),
    )
    return me.apply_merges(
        t.merge_requests, empty_table(t.spark, "project_merge_decisions"), t.projects, t.evidence, pairs, as_of()
    )


@query(
    "merge_apply",
    with_views(
        f"""WITH acc AS ({ACCEPTED}),
            losing AS (SELECT e.*, acc.surviving_project_id, row_number() OVER (
                         PARTITION BY surviving_project_id, session_id, message_id ORDER BY e.created_at DESC, e.id) AS rn
                       FROM v_evidence e JOIN acc ON e.entity_type = 'project' AND e.entity_id = acc.merged_project_id)
            SELECT id, entity_type, entity_id, session_id, message_id FROM v_evidence e
            WHERE NOT (entity_type = 'project' AND entity_id IN (SELECT merged_project_id FROM acc))
            UNION ALL
            SELECT id, entity_type, surviving_project_id, session_id, message_id FROM losing l
            WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_evidence h WHERE h.entity_type = 'project' AND h.entity_id = l.surviving_project_id
                                         AND h.session_id = l.session_id AND h.message_id IS NOT DISTINCT FROM l.message_id)"""
    ),
)
def merge_apply(t: Testbed) -> DataFrame:
    return _merged(t).evidence.select("id", "entity_type", "entity_id", "session_id", "message_id")


@query(
    "merge_outcome",
    with_views(
        f"""WITH acc AS ({ACCEPTED})
            SELECT p.id, CASE WHEN acc.merged_project_id IS NOT NULL THEN 'archived' ELSE p.status END AS status,
                   acc.surviving_project_id AS survivor_id,
                   CASE WHEN acc.merged_project_id IS NOT NULL OR r.merged_project_id IS NULL THEN NULL
                        WHEN s.status = 'archived' THEN 'survivor_archived' ELSE 'merged_archived' END AS problem
            FROM v_projects p LEFT JOIN acc ON acc.merged_project_id = p.id
            LEFT JOIN v_merge_requests r ON r.merged_project_id = p.id LEFT JOIN v_projects s ON s.id = r.surviving_project_id"""
    ),
)
def merge_outcome(t: Testbed) -> DataFrame:
    """Status of every project after the merges, where it went, and why a request was refused."""
    merged = _merged(t)
    refused = merged.rejected.select(F.col("merged_project_id").alias("id"), F.col("verdict").alias("problem"))
    rows = me.resolve_survivor(merged.projects.select("id", "status"), merged.decisions)
    return rows.join(refused, "id", "left")


@query(
    "merge_candidates_left",
    with_views(
        f"""WITH acc AS ({ACCEPTED}), touched AS (SELECT surviving_project_id AS id FROM acc UNION SELECT merged_project_id FROM acc)
            SELECT least(surviving_project_id, merged_project_id) AS project_a_id, greatest(surviving_project_id, merged_project_id) AS project_b_id
            FROM v_merge_requests WHERE surviving_project_id NOT IN (SELECT id FROM touched) AND merged_project_id NOT IN (SELECT id FROM touched)"""
    ),
)
def merge_candidates_left(t: Testbed) -> DataFrame:
    return _merged(t).candidates.select("project_a_id", "project_b_id")


# --- recommendations ------------------------------------------------------------------------------------

STALLED = f"""
    SELECT 1 AS gen, row_number() OVER (ORDER BY last_seen_at DESC, id) AS place, 'Resume: ' || substring(canonical_title, 1, 80) AS title,
           'This project was active across ' || session_count || ' sessions but hasn''t had activity in ' || days ||
           ' days. Consider picking it back up or archiving it.' AS rationale,
           least(0.5::double + session_count * 0.05::double, 0.85::double) AS priority_score, 'project' AS entity_type, id AS entity_id
    FROM (SELECT *, trunc((epoch_us({NOW}) - epoch_us(last_seen_at)) / 86400000000)::bigint AS days FROM ({ENRICHED_PROJECTS})
          WHERE status = 'stalled' AND session_count >= 3 ORDER BY last_seen_at DESC, id LIMIT 5)"""
RISING = f"""
    SELECT 3, row_number() OVER (ORDER BY session_count DESC, last_seen_at DESC, id), 'Active topic: ' || substring(label, 1, 80),
           'This theme appeared in ' || recent_count || ' sessions over the last 2 weeks and is trending upward. Consider whether this deserves a dedicated project.',
           least(0.5::double + recent_count * 0.05::double, 0.85::double), 'theme', id
    FROM (SELECT * FROM ({RECURRENCE}) WHERE recent_count >= 5 AND trend = 'rising' ORDER BY session_count DESC, last_seen_at DESC, id LIMIT 3)"""
REVISIT = f"""
    SELECT 4, row_number() OVER (ORDER BY word_count DESC, session_id), 'Revisit: ' || coalesce(title, 'Untitled session'),
           'This session from ' || coalesce(strftime(started_at, '%Y-%m-%d'), 'unknown date') || ' had ' || message_count || ' messages and '
           || format('{{:,}}', word_count) || ' words ' || chr(8212) || ' a substantial discussion worth revisiting.',
           least(0.4::double + word_count / 10000.0::double, 0.75::double), 'session', session_id
    FROM (SELECT m.*, s.title, s.started_at FROM ({METRICS}) m JOIN v_sessions s ON s.id = m.session_id
          WHERE message_count >= 6 AND word_count >= 400
            AND coalesce(s.started_at, s.created_at)::date <= date '2024-02-15' - 30 ORDER BY word_count DESC, session_id LIMIT 5)"""
CONSOLIDATE = f"""
    SELECT 2, row_number() OVER (ORDER BY score DESC, project_a_id, project_b_id), 'Merge: "' || substring(ta, 1, 40) || '" and "' || substring(tb, 1, 40) || '"',
           'These two projects have ' || floor(score * 100 + 0.5)::bigint || '% similarity. Consider merging them to consolidate your work history.',
           least(score, 0.9::double), 'project', project_a_id
    FROM (SELECT c.*, a.canonical_title AS ta, b.canonical_title AS tb FROM ({best_pairs_sql('(SELECT *, NULL::varchar AS description FROM v_projects)')}) c
          JOIN v_projects a ON a.id = project_a_id AND a.status <> 'archived' JOIN v_projects b ON b.id = project_b_id AND b.status <> 'archived'
          WHERE score > 0.6 ORDER BY score DESC, project_a_id, project_b_id LIMIT 3)"""
GEN_COLS = f"title, rationale, {sql_round('priority_score')} AS priority_score, entity_id"


def _named(sql: str) -> str:
    return f"SELECT {GEN_COLS} FROM (SELECT * FROM ({sql}) t(gen, place, title, rationale, priority_score, entity_type, entity_id))"


def _generator_rows(df: DataFrame) -> DataFrame:
    return df.select("title", "rationale", "priority_score", "entity_id")


def _stalled(t: Testbed) -> DataFrame:
    enriched = en.enrich_projects(t.projects, t.evidence, t.sessions, as_of())
    return re.stalled_candidates(da.project_activity(enriched, t.evidence, as_of()))


def _consolidate(t: Testbed) -> DataFrame:
    return re.consolidation_candidates(me.candidate_list(me.merge_candidates(t.projects), t.projects))


def _rising(t: Testbed) -> DataFrame:
    return re.rising_candidates(da.theme_recurrence(t.themes, t.evidence, as_of()))


def _revisit(t: Testbed) -> DataFrame:
    metrics = an.session_metrics(t.sessions, t.messages)
    return re.revisit_candidates(metrics, t.sessions, as_of(AS_OF_REVISIT), min_messages=6, min_words=400)


@query("recs_stalled", with_views(_named(STALLED)))
def recs_stalled(t: Testbed) -> DataFrame:
    return _generator_rows(_stalled(t))


@query("recs_consolidate", with_views(_named(CONSOLIDATE)))
def recs_consolidate(t: Testbed) -> DataFrame:
    return _generator_rows(_consolidate(t))


@query("recs_rising", with_views(_named(RISING)))
def recs_rising(t: Testbed) -> DataFrame:
    return _generator_rows(_rising(t))


@query("recs_revisit", with_views(_named(REVISIT)))
def recs_revisit(t: Testbed) -> DataFrame:
    return _generator_rows(_revisit(t))


LATEST = """
    SELECT entity_type, entity_id, arg_max(session_id, created_at) AS session_id, arg_max(message_id, created_at) AS message_id
    FROM v_evidence GROUP BY ALL"""
GENERATED = f"""
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY gen, place) AS turn,
           title IN (SELECT 'Resume: ' || canonical_title FROM v_projects WHERE canonical_title LIKE 'small%') AS open_before
    FROM (SELECT g.*, l.session_id, l.message_id FROM gens g JOIN ({LATEST}) l USING (entity_type, entity_id)
          UNION ALL SELECT g.*, entity_id, NULL FROM gens g WHERE entity_type = 'session')""".replace(
    "gens", f"(SELECT * FROM ({STALLED} UNION ALL {CONSOLIDATE} UNION ALL {RISING} UNION ALL {REVISIT}) t(gen, place, title, rationale, priority_score, entity_type, entity_id))"
)


def _open_before(t: Testbed) -> DataFrame:
    """Open recommendations for some project titles, and dismissed ones for the others."""
    titles = t.projects.select("canonical_title").distinct()
    small = F.col("canonical_title").startswith("small")
    return conform(
        titles.select(
            make_id("recommendation", F.col("canonical_title")).alias("id"),
            F.concat(F.lit("Resume: "), F.col("canonical_title")).alias("title"),
            F.lit("revive_stalled").alias("recommendation_type"), F.lit(0.5).alias("priority_score"),
            as_of().alias("created_at"), F.when(~small, as_of()).alias("dismissed_at"),
        ),
        "recommendations",
    )


def _generated(t: Testbed) -> re.Generated:
    parts = [_stalled(t), _consolidate(t), _rising(t), _revisit(t)]
    return re.generate_recommendations(parts, t.evidence, _open_before(t), as_of())


@query(
    "recs_generated",
    with_views(
        f"""SELECT title, recommendation_type, {sql_round('priority_score')} AS priority_score, session_id, message_id FROM (
              SELECT *, CASE gen WHEN 1 THEN 'revive_stalled' WHEN 2 THEN 'consolidate' WHEN 3 THEN 'reflect_pattern' ELSE 'revisit_decision' END AS recommendation_type
              FROM ({GENERATED})) WHERE turn = 1 AND NOT open_before"""
    ),
)
def recs_generated(t: Testbed) -> DataFrame:
    made = _generated(t)
    links = made.evidence.select(F.col("entity_id").alias("id"), "session_id", "message_id")
    return made.recommendations.join(links, "id").select("title", "recommendation_type", "priority_score", "session_id", "message_id")


@query(
    "recs_counts",
    with_views(
        f"""SELECT count(*) FILTER (turn = 1 AND NOT open_before) AS created, count(*) FILTER (turn > 1 OR open_before) AS skipped_duplicate
            FROM ({GENERATED})"""
    ),
)
def recs_counts(t: Testbed) -> DataFrame:
    return _generated(t).counts


@query(
    "recs_seed",
    with_views(
        f"""SELECT 'Review speculative projects' AS title, l.session_id, l.message_id
            FROM (SELECT id FROM v_projects WHERE status <> 'archived' ORDER BY last_seen_at DESC, id LIMIT 1) p
            JOIN ({LATEST}) l ON l.entity_type = 'project' AND l.entity_id = p.id"""
    ),
)
def recs_seed(t: Testbed) -> DataFrame:
    none = empty_table(t.spark, "recommendations")
    made = re.seed_recommendation(none, t.projects, t.evidence, t.sessions, t.messages, as_of())
    links = made.evidence.select(F.col("entity_id").alias("id"), "session_id", "message_id")
    return made.recommendations.join(links, "id").select("title", "session_id", "message_id")


RECS = """
    SELECT event_id::varchar AS id, CASE event_type WHEN 'view' THEN 'revive_stalled' WHEN 'click' THEN 'consolidate'
             WHEN 'error' THEN 'reflect_pattern' ELSE 'next_action' END AS recommendation_type,
           'Rec ' || event_id AS title, value AS priority_score, ts AS created_at,
           CASE WHEN event_id % 3 = 0 THEN ts END AS dismissed_at, CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN ts END AS accepted_at
    FROM events"""


def _recs(t: Testbed) -> DataFrame:
    """Every event as a recommendation in some state."""
    at, n = F.col("ts").cast("timestamp"), F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "revive_stalled").when(F.col("event_type") == "click", "consolidate")
        .when(F.col("event_type") == "error", "reflect_pattern").otherwise("next_action")
    )
    return conform(
        t.table("events").select(
            n.cast("string").alias("id"), kind.alias("recommendation_type"), F.concat(F.lit("Rec "), n.cast("string")).alias("title"),
            F.col("value").alias("priority_score"), at.alias("created_at"), F.when(n % 3 == 0, at).alias("dismissed_at"),
            F.when((n % 3 == 1) & (n % 2 == 0), at).alias("accepted_at"),
        ),
        "recommendations",
    )


@query(
    "recs_open",
    f"SELECT id, title, {sql_round('priority_score')} AS priority_score FROM ({RECS}) WHERE dismissed_at IS NULL AND accepted_at IS NULL",
)
def recs_open(t: Testbed) -> DataFrame:
    return re.open_recommendations(_recs(t)).select("id", "title", "priority_score")


SECTION_ROWS = ", ".join(f"({i}, '{k}', '{s}')" for i, (k, s) in enumerate(re.SECTIONS))


@query(
    "recs_sections",
    with_views(
        f"""SELECT s.section_no::bigint AS section_no, s.section, r.id, e.session_id
            FROM (VALUES {SECTION_ROWS}) s(section_no, kind, section)
            LEFT JOIN ({RECS}) r ON r.recommendation_type = s.kind AND dismissed_at IS NULL AND accepted_at IS NULL
            LEFT JOIN v_links e ON e.event_id::varchar = r.id"""
    ),
)
def recs_sections(t: Testbed) -> DataFrame:
    links = t.evidence.filter("entity_type = 'theme'").select(
        F.regexp_extract("id", "([0-9]+)", 1).alias("entity_id"), F.lit("recommendation").alias("entity_type"), "session_id",
        "message_id", "excerpt", "created_at",
    )
    return re.recommendations_by_section(_recs(t), links).select("section_no", "section", "id", "session_id")


@query(
    "recs_actions",
    f"""SELECT id, {sql_time("CASE WHEN id::bigint % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE accepted_at END")} AS accepted_at,
           {sql_time("CASE WHEN id::bigint % 5 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE dismissed_at END")} AS dismissed_at FROM ({RECS})""",
)
def recs_actions(t: Testbed) -> DataFrame:
    at = as_of("2024-02-01 00:00:00")
    n = F.col("event_id") % 5
    actions = t.table("events").select(
        F.col("event_id").cast("string").alias("id"), F.when(n == 0, "accept").when(n == 1, "dismiss").otherwise("none").alias("action"), at.alias("at")
    )
    return re.apply_actions(_recs(t), actions).select("id", "accepted_at", "dismissed_at")


# --- profile --------------------------------------------------------------------------------------------

def _labels_sql(kind: str) -> str:
    return f"""SELECT session_id, string_agg(label, ',' ORDER BY entity_id) AS labels, count(*) AS n
        FROM ({INTELLIGENCE}) WHERE entity_type = '{kind}' GROUP BY session_id"""


def digests_sql() -> str:
    return f"""
    SELECT s.id AS session_id, coalesce(s.title, 'Untitled') AS title, {sql_time('s.started_at')} AS started_at, m.duration_minutes,
           m.message_count, m.user_msg_count, m.assistant_msg_count, m.word_count, coalesce(k.top_keywords, '') AS top_keywords,
           coalesce(p.labels, '') AS linked_projects, coalesce(p.n, 0) AS project_count, coalesce(h.labels, '') AS linked_themes,
           coalesce(h.n, 0) AS theme_count, coalesce(substring(u.first_user, 1, 150), '') AS first_user_snippet
    FROM v_sessions s JOIN ({METRICS}) m ON m.session_id = s.id LEFT JOIN ({keywords_sql('v_messages')}) k ON k.session_id = s.id
    LEFT JOIN ({_labels_sql('project')}) p ON p.session_id = s.id LEFT JOIN ({_labels_sql('theme')}) h ON h.session_id = s.id
    LEFT JOIN (SELECT session_id, arg_min(content_text, sort_order) AS first_user FROM v_messages WHERE role = 'user' GROUP BY 1) u ON u.session_id = s.id"""


def _digests(t: Testbed) -> DataFrame:
    analytics = an.compute_session_analytics(t.sessions, t.messages, as_of())
    return pf.session_digests(t.sessions, t.messages, analytics, da.session_intelligence(t.evidence, t.projects, t.themes))


@query("session_digests", lambda: with_views(digests_sql()))
def session_digests(t: Testbed) -> DataFrame:
    return _digests(t)


@query(
    "digest_batches",
    lambda: with_views(
        """SELECT batch_no, count(*) AS digest_count, string_agg(session_id, ',' ORDER BY rn) AS ids FROM (
             SELECT id AS session_id, row_number() OVER (ORDER BY started_at DESC NULLS LAST, id) - 1 AS rn,
                    (row_number() OVER (ORDER BY started_at DESC NULLS LAST, id) - 1) // 50 AS batch_no FROM v_sessions)
           GROUP BY batch_no"""
    ),
)
def digest_batches(t: Testbed) -> DataFrame:
    batches = pf.digest_batches(_digests(t))
    ids = F.transform(F.from_json("digests", "array<struct<id: string>>"), lambda d: d.getField("id"))
    return batches.select("batch_no", "digest_count", ids.alias("ids"))


# Model answers derived from the documents: a trait per document, batched by ten documents.
ANSWERS = """
    SELECT d.doc_id // 10 AS batch_no, d.doc_id % 10 AS trait_no, d.source || ' ' || lang AS label, 'd' || d.doc_id AS description,
           CASE WHEN d.doc_id % 4 = 0 THEN 'odd' ELSE 'workflow' END AS category,
           CASE WHEN d.doc_id % 6 = 0 THEN 0.3 ELSE least(1, (n_chars % 1200) / 1000.0) END::double AS confidence, 0.3::double AS impact_score,
           [(d.doc_id % 50)::varchar, (d.doc_id % 70)::varchar, 's' || (d.doc_id % 3)] AS ids
    FROM documents d"""


def _responses(t: Testbed) -> DataFrame:
    """Raw answers: a score may be text or above one, every thirteenth answer is broken."""
    n = F.col("doc_id")
    mixed = F.when(n % 2 == 0, F.initcap(F.col("source"))).otherwise(F.col("source"))
    score = F.when(n % 6 == 0, F.lit('"high"')).otherwise((F.col("n_chars") % 1200 / 1000).cast("string"))
    label = F.concat(F.lit('"'), mixed, F.lit(" "), F.col("lang"), F.lit('"'))
    trait = F.concat(
        F.lit('{"label":'), label, F.lit(',"description":"d'), n.cast("string"), F.lit('","category":"'),
        F.when(n % 4 == 0, "odd").otherwise("workflow"), F.lit('","confidence":'), score, F.lit(',"evidence_session_ids":["'),
        (n % 50).cast("string"), F.lit('","'), (n % 70).cast("string"), F.lit('",7,"s'), (n % 3).cast("string"), F.lit('"]}'),
    )
    batched = t.table("documents").groupBy(F.floor(n / 10).alias("batch_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), trait.alias("t")))), lambda s: s.getField("t")), ",").alias("ts")
    )
    answer = F.concat(
        F.lit('{"summary":"s'), F.col("batch_no").cast("string"), F.lit('","strengths":["a",1,"b"],"traits":['), F.col("ts"), F.lit("]}")
    )
    broken = F.concat(F.lit("x"), answer)
    return batched.select("batch_no", F.when(F.col("batch_no") % 13 == 12, broken).otherwise(answer).alias("response"))


GOOD = f"(SELECT * FROM ({ANSWERS}) WHERE batch_no % 13 <> 12)"


@query(
    "profile_responses",
    f"""SELECT batch_no, trait_no, lower(label) AS label_key, description, category, {sql_round('confidence')} AS confidence,
           {sql_round('impact_score')} AS impact_score, array_to_string(ids, ',') AS evidence_session_ids FROM {GOOD}""",
)
def profile_responses(t: Testbed) -> DataFrame:
    _, traits = pf.parse_profile_responses(_responses(t))
    return traits.withColumn("label_key", F.lower("label")).drop("label")


TRAITS = f"""
    SELECT label_key, arg_min(description, k) AS description, arg_min(category, k) AS category, max(confidence) AS confidence,
           arg_min(label, k) AS label
    FROM (SELECT *, lower(label) AS label_key, row_number() OVER (ORDER BY confidence DESC, batch_no, trait_no) AS k FROM {GOOD}) GROUP BY label_key"""


@query("trait_merge", f"SELECT label_key, description, category, {sql_round('confidence')} AS confidence FROM ({TRAITS})")
def trait_merge(t: Testbed) -> DataFrame:
    merged, _ = pf.merge_traits(pf.parse_profile_responses(_responses(t))[1])
    return merged.select("label_key", "description", "category", "confidence")


TRAIT_IDS = f"""
    SELECT lower(label) AS label_key, session_id, min(batch_no * 100000 + trait_no * 100 + pos) AS place
    FROM (SELECT *, unnest(ids) AS session_id, generate_subscripts(ids, 1) AS pos FROM {GOOD}) GROUP BY ALL"""


@query("trait_evidence", f"SELECT label_key, session_id FROM ({TRAIT_IDS})")
def trait_evidence(t: Testbed) -> DataFrame:
    _, evidence = pf.merge_traits(pf.parse_profile_responses(_responses(t))[1])
    return evidence.select("label_key", "session_id")


def _old_patterns(t: Testbed) -> DataFrame:
    """A pattern known before for every source's English label, written in both ways."""
    sources = t.table("documents").select("source").distinct()
    both = sources.select(F.explode(F.array("source", F.initcap("source"))).alias("s"))
    return conform(
        both.select(F.concat(F.lit("old "), "s").alias("id"), F.concat("s", F.lit(" en")).alias("label"), F.lit("temporal").alias("category"),
                    F.lit(0.1).alias("confidence"), as_of().alias("last_seen_at")),
        "patterns",
    )


def _patterns(t: Testbed) -> tuple[DataFrame, DataFrame, DataFrame]:
    merged, evidence = pf.merge_traits(pf.parse_profile_responses(_responses(t))[1])
    return pf.upsert_patterns(_old_patterns(t), merged, as_of()), merged, evidence


@query(
    "pattern_rows",
    f"""SELECT lower(label) AS label_key, max(confidence) AS confidence, arg_max(category, confidence) AS category FROM (
          SELECT label, {sql_round('confidence')} AS confidence, CASE WHEN label LIKE '% en' THEN 'temporal' WHEN category = 'odd' THEN 'other' ELSE category END AS category
          FROM ({TRAITS})
          UNION ALL SELECT DISTINCT source || ' en', 0.1::double, 'temporal' FROM documents) GROUP BY 1""",
)
def pattern_rows(t: Testbed) -> DataFrame:
    patterns, _, _ = _patterns(t)
    best = patterns.groupBy(F.lower("label").alias("label_key"))
    return best.agg(F.max("confidence").alias("confidence"), F.max_by("category", "confidence").alias("category"))


@query(
    "pattern_links",
    with_views(
        f"""SELECT label_key, session_id FROM (
              SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY place, session_id) AS rn FROM ({TRAIT_IDS})
              WHERE session_id IN (SELECT id FROM v_sessions)) WHERE rn <= 10"""
    ),
)
def pattern_links(t: Testbed) -> DataFrame:
    patterns, merged, evidence = _patterns(t)
    links = pf.pattern_evidence(merged, evidence, patterns, t.sessions, as_of())
    names = patterns.select(F.col("id").alias("entity_id"), F.lower("label").alias("label_key"))
    return links.join(names, "entity_id").select("label_key", "session_id")


@query(
    "pattern_list",
    f"SELECT lower(label) AS label_key, category, count(*) AS n_ids FROM ({TRAITS}) JOIN ({TRAIT_IDS}) USING (label_key) WHERE category = 'workflow' GROUP BY ALL",
)
def pattern_list(t: Testbed) -> DataFrame:
    """Workflow patterns with all their session ids as links."""
    merged, evidence = pf.merge_traits(pf.parse_profile_responses(_responses(t))[1])
    patterns = pf.upsert_patterns(empty_table(t.spark, "patterns"), merged, as_of())
    keys = patterns.select(F.col("id").alias("entity_id"), F.lower("label").alias("label_key"))
    links = evidence.join(keys, "label_key").withColumn("entity_type", F.lit("pattern"))
    listed = pf.pattern_list(patterns, links, "workflow")
    return listed.groupBy(F.lower("label").alias("label_key"), "category").agg(F.count("*").alias("n_ids"))


@query(
    "profile_row",
    with_views(
        f"""SELECT 'default' AS id, 's' || max(batch_no) AS summary, 'a,b' AS strengths, '' AS growth_areas, 'Unknown' AS work_style,
               (SELECT count(*) FROM v_sessions) AS session_count_at_computation FROM {GOOD}"""
    ),
)
def profile_row(t: Testbed) -> DataFrame:
    profiles, _ = pf.parse_profile_responses(_responses(t))
    row = pf.profile_row(profiles, t.sessions, "local", as_of())
    return row.select("id", "summary", "strengths", "growth_areas", "work_style", "session_count_at_computation")


@query(
    "prompt_messages",
    with_views(
        """SELECT s.id AS session_id, coalesce(s.title, 'Untitled session') AS title, md5(coalesce(u.m, '')) AS text_md5
           FROM v_sessions s LEFT JOIN (
             SELECT session_id, string_agg(substring(content_text, 1, 200), chr(10) ORDER BY sort_order) AS m FROM (
               SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sort_order) AS rn FROM v_all_messages WHERE role = 'user')
             WHERE rn <= 10 GROUP BY session_id) u ON u.session_id = s.id"""
    ),
)
def prompt_messages(t: Testbed) -> DataFrame:
    rows = pf.prompt_messages(t.sessions, t.all_messages)
    return rows.select("session_id", "title", F.md5("user_messages").alias("text_md5"))


@query(
    "prompt_titles",
    with_views(
        """SELECT p.id, p.canonical_title, coalesce(x.titles, '') AS session_titles FROM v_projects p LEFT JOIN (
             SELECT entity_id, string_agg(title, ', ' ORDER BY rn) AS titles FROM (
               SELECT entity_id, title, row_number() OVER (PARTITION BY entity_id ORDER BY max(e.created_at) DESC, session_id) AS rn
               FROM v_evidence e JOIN v_sessions s ON s.id = e.session_id
               WHERE entity_type = 'project' AND title IS NOT NULL GROUP BY entity_id, session_id, title)
             WHERE rn <= 20 GROUP BY entity_id) x ON x.entity_id = p.id"""
    ),
)
def prompt_titles(t: Testbed) -> DataFrame:
    return pf.prompt_titles(t.projects, t.evidence, t.sessions)


@query(
    "topic_responses",
    """SELECT doc_id::varchar AS session_id, CASE doc_id % 4 WHEN 0 THEN lang || ',' || source WHEN 1 THEN source ELSE '' END AS topics FROM documents""",
)
def topic_responses(t: Testbed) -> DataFrame:
    """Answers that are an array, an object with topics, an object without, and no JSON."""
    n = F.col("doc_id") % 4
    quoted = {c: F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("lang", "source")}
    answer = (
        F.when(n == 0, F.concat(F.lit("["), quoted["lang"], F.lit(",3,"), quoted["source"], F.lit("]")))
        .when(n == 1, F.concat(F.lit('{"topics":['), quoted["source"], F.lit(",null]}")))
        .when(n == 2, F.concat(F.lit('{"words":['), quoted["source"], F.lit("]}")))
        .otherwise(F.concat(F.lit("Topics: "), F.col("lang")))
    )
    return pf.parse_topics(t.table("documents").select(F.col("doc_id").cast("string").alias("session_id"), answer.alias("response")))
