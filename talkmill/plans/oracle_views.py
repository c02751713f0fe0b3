"""DuckDB text of the testbed's views, and small builders for the check queries."""

from __future__ import annotations

import re

from talkmill.functions.text import TERM_PATTERN, WS

SEP = "chr(31)"


def sql_id(*parts: str) -> str:
    """The deterministic id of ``make_id`` as SQL."""
    return "sha256(concat_ws(" + SEP + ", " + ", ".join(
        f"coalesce('v' || ({p})::varchar, 'n')" for p in parts
    ) + "))"


def sql_round(x: str, digits: int = 6) -> str:
    scale = float(10**digits)
    return f"(floor(({x})::double * {scale!r} + 0.5)::double / {scale!r})"


def sql_time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def sql_terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TERM_PATTERN}')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


VIEWS = {
    "v_messages": """
        SELECT conv_id || '-' || turn AS id, conv_id::varchar AS session_id, role,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds((conv_id % 30) * 86400 + turn * 90) AS ts,
               text AS content_text, turn::bigint AS sort_order
        FROM conversations""",
    "v_all_messages": """
        SELECT id, session_id, role, content_text, sort_order FROM v_messages
        UNION ALL
        SELECT 'd' || doc_id, (doc_id % 100)::varchar, 'user', text, doc_id + 1000 FROM documents""",
    "v_sessions": """
        SELECT conv_id::varchar AS id, 'src' || (conv_id % 3) AS source_id, 'batch' || (conv_id % 5) AS import_batch_id,
               CASE WHEN conv_id % 4 <> 0 THEN 'Topic ' || (conv_id % 7) END AS title,
               CASE WHEN conv_id % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days((conv_id % 30)::integer) END AS started_at,
               TIMESTAMP '2024-01-30 00:00:00' + to_seconds(conv_id) AS created_at,
               TIMESTAMP '2024-01-30 00:00:00' + to_seconds(conv_id) AS updated_at
        FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "v_event_sessions": """
        SELECT event_id::varchar AS id, 'src' || (user_id % 3) AS source_id, event_type AS title,
               ts AS started_at, ts AS created_at
        FROM events""",
    "v_sources": """
        SELECT * FROM (VALUES ('src0', 'chatgpt'), ('src1', 'claude'), ('src2', 'generic')) t(id, type)""",
    "v_batches": """
        SELECT id, TIMESTAMP '2024-01-20 00:00:00' + to_days(n::integer) AS imported_at, id || '.json' AS file_name,
               CASE WHEN n = 4 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN n <= 1 THEN 0 ELSE 1 END AS search_index_version
        FROM (SELECT DISTINCT import_batch_id AS id, replace(import_batch_id, 'batch', '')::integer AS n FROM v_sessions)""",
    "v_artifacts": """
        SELECT 'a' || doc_id AS id, (doc_id % 100)::varchar AS session_id,
               CASE WHEN doc_id % 2 = 1 THEN (doc_id % 100) || '-0' END AS message_id,
               source AS title, text AS content_text
        FROM documents""",
    "v_chunk_texts": """
        SELECT session_id, id AS message_id, NULL::varchar AS artifact_id, 'message' AS chunk_type, content_text FROM v_messages
        UNION ALL
        SELECT session_id, message_id, id, 'artifact', content_text FROM v_artifacts""",
    "v_chunks": f"""
        SELECT {sql_id("'chunk'", "session_id", "message_id", "artifact_id", "s")} AS id, session_id, message_id, artifact_id,
               chunk_type, s AS start_offset, least(s + 8000, length(content_text)) AS end_offset,
               substring(content_text, s + 1, 8000) AS text
        FROM (SELECT *, unnest(generate_series(0, (ceil(greatest(0, length(content_text) - 8000) / 7800.0) * 7800)::bigint, 7800)) AS s
              FROM v_chunk_texts WHERE length(content_text) > 0)""",
    "v_links": """
        SELECT event_id, event_type, user_id, ts, (user_id + event_id % 7)::varchar AS session_id,
               CASE WHEN user_id % 3 = 0 THEN ts - INTERVAL 45 DAY ELSE ts END AS project_ts
        FROM events""",
    "v_evidence": """
        SELECT event_id || '-t' AS id, 'theme' AS entity_type, event_type AS entity_id, session_id,
               session_id || '-' || (event_id % 5) AS message_id, 'event ' || event_id AS excerpt, ts AS created_at
        FROM v_links
        UNION ALL
        SELECT event_id || '-p', 'project', 'p' || user_id, session_id, session_id || '-' || (event_id % 5),
               'event ' || event_id, project_ts
        FROM v_links""",
    "v_themes": """
        SELECT event_type AS id, event_type AS label, min(ts) AS first_seen_at, max(ts) AS last_seen_at
        FROM v_links GROUP BY event_type""",
    "v_projects": """
        SELECT 'p' || user_id AS id, coalesce(p_name, 'project ' || user_id) AS canonical_title,
               CASE WHEN user_id % 13 = 0 THEN 'archived' ELSE 'speculative' END AS status,
               0.35::double AS confidence,
               CASE WHEN user_id % 5 <> 0 THEN (user_id % 10) / 10.0::double END AS momentum_score,
               first_seen_at, last_seen_at
        FROM (SELECT user_id, min(project_ts) AS first_seen_at, max(project_ts) AS last_seen_at FROM v_links GROUP BY user_id)
        LEFT JOIN part ON p_partkey = user_id""",
    "v_merge_input": """
        SELECT 'p' || p_partkey AS id, p_name AS canonical_title,
               CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS description,
               CASE WHEN p_partkey % 13 = 0 THEN 'archived' ELSE 'speculative' END AS status,
               first_seen_at, last_seen_at
        FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at
                        FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "v_merge_requests": """
        SELECT s AS surviving_project_id, id AS merged_project_id
        FROM (SELECT id, min(id) OVER (PARTITION BY canonical_title) AS s FROM v_projects) WHERE id <> s""",
}



def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the views that a query names, and those they need, in front of it as CTEs."""
    views = {**VIEWS, **(extra or {})}
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        for other in views:
            if other != name and re.search(rf"\b{other}\b", views[name]):
                add(other)
        wanted.append(name)

    for name in views:
        if re.search(rf"\b{name}\b", body):
            add(name)
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in wanted)
    if not ctes:
        return body
    own = body.strip()
    return f"WITH {ctes},\n{own[5:]}" if own.upper().startswith("WITH ") else f"WITH {ctes}\n{own}"
