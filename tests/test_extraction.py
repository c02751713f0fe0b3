from pyspark.sql import functions as F

from helpers import one, table, ts, values
from talkmill.operators import enrichment as en
from talkmill.operators import extraction as ex
from talkmill.schema import empty_table

NOW = "2024-03-01 00:00:00"


def msg(session, order, text, role="user", at=None):
    return {"id": f"{session}-{order}", "session_id": session, "role": role, "content_text": text, "sort_order": order, "timestamp": at}


def test_project_titles_and_seen_range(spark):
    sessions = table(spark, "sessions", [
        {"id": "t", "title": "  Plan  ", "started_at": "2024-01-01 00:00:00", "updated_at": "2024-01-05 00:00:00"},
        {"id": "u", "title": " ", "started_at": None, "updated_at": None}, {"id": "sys", "title": "only system"}, {"id": "empty"}, {"id": "blank"},
        {"id": "long", "title": "x" * 600},
    ])
    messages = table(spark, "messages", [
        msg("t", 1, "second", at="2024-01-02 00:00:00"), msg("t", 0, "hi", "assistant"), msg("u", 3, " " * 300 + "y" * 200),
        msg("sys", 0, "s", "system"), msg("blank", 0, "  "), msg("long", 0, "q" * 600),
    ])
    found = ex.extract_projects(sessions, messages, None, ts(NOW))
    rows = {r["session_id"]: r for r in found.projects.withColumnRenamed("id", "entity_id").join(
        found.evidence.drop("id"), "entity_id").collect()}
    assert {k: r["canonical_title"] for k, r in rows.items()} == {"t": "Plan", "u": "y" * 120, "long": "x" * 500}
    assert (str(rows["t"]["first_seen_at"]), str(rows["t"]["last_seen_at"])) == ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert str(rows["u"]["first_seen_at"]) == str(rows["u"]["last_seen_at"]) == NOW
    assert rows["t"]["message_id"] == "t-1" and len(rows["long"]["excerpt"]) == 500
    assert ex.extract_nothing(sessions, messages, None, ts(NOW)).projects.count() == 0


def test_backfill_skips_done_sessions_and_counts_yielding_ones(spark):
    sessions = table(spark, "sessions", [{"id": f"s{i}", "started_at": f"2024-01-0{i} 00:00:00", "title": "a"} for i in range(1, 6)])
    messages = table(spark, "messages", [msg(f"s{i}", 0, "x") for i in (1, 2, 3, 4)])
    links = table(spark, "evidence_links", [{"id": "e", "entity_type": "project", "entity_id": "p", "session_id": "s4"},
                                            {"id": "f", "entity_type": "theme", "entity_id": "t", "session_id": "s3"}])
    two = ex.extract_missing(sessions, messages, None, links, ts(NOW), max_sessions=2)
    assert values(two.evidence, "session_id") == [("s2",), ("s3",)] and two.projects.count() == 2
    everything = links.unionByName(ex.extract_missing(sessions, messages, None, links, ts(NOW)).evidence)
    assert ex.extract_missing(sessions, messages, None, everything, ts(NOW)).projects.count() == 0


def test_themes_are_shared_and_keep_the_first_span(spark):
    sessions = table(spark, "sessions", [
        {"id": "a", "title": "Same", "started_at": "2024-01-01 00:00:00"}, {"id": "b", "title": "Same ", "started_at": "2024-02-01 00:00:00"},
        {"id": "c", "title": None, "started_at": "2024-01-03 00:00:00"}, {"id": "d", "title": "Known"}, {"id": "e", "title": None},
    ])
    messages = table(spark, "messages", [msg("c", 0, " Same", at="2024-01-03 00:00:00"), msg("e", 0, "x", "assistant")])
    known = table(spark, "themes", [{"id": "k2", "label": "Known"}, {"id": "k1", "label": "Known"}])
    new, links = ex.assign_themes(sessions, messages, known, empty_table(spark, "evidence_links"), ts(NOW))
    assert values(new.select("label", F.col("first_seen_at").cast("string").alias("f")), "label", "f") == [("Same", "2024-02-01 00:00:00")]
    theme = one(new, "id")
    assert values(links, "session_id", "entity_id") == [("a", theme), ("b", theme), ("c", theme), ("d", "k1")]
    again, more = ex.assign_themes(sessions, messages, known.unionByName(new), links, ts(NOW))
    assert again.count() == 0 and more.count() == 0


def link(key, entity, session, at, kind="project"):
    return {"id": key, "entity_type": kind, "entity_id": entity, "session_id": session, "created_at": at}


def test_project_enrichment_rules(spark):
    def p(key, last, status="speculative", confidence=0.35):
        return {"id": key, "canonical_title": key, "status": status, "confidence": confidence, "last_seen_at": last, "description": "old",
                "first_seen_at": "2024-01-01 00:00:00"}

    sessions = table(spark, "sessions", [{"id": f"s{i}", "title": t, "source_id": f"src{i % 2}"} for i, t in enumerate(
        ["T0", "T1", " T1 ", None, "", "T5", "T6", "T7"])])
    projects = table(spark, "projects", [
        p("busy", "2024-02-29 00:00:00", "completed"), p("stale", "2024-01-30 00:00:00", confidence=0.8), p("edge", "2024-01-30 12:00:00"),
        p("single", "2024-02-29 00:00:00"), p("none", "2024-02-29 00:00:00"), p("gone", "2023-01-01 00:00:00", "archived"),
    ])
    rows = [link(f"b{i}", "busy", f"s{i}", f"2024-02-{20 - i} 00:00:00") for i in range(8)]
    rows += [link("x1", "stale", "s0", "2024-01-05 00:00:00"), link("x2", "stale", "lost", "2024-01-06 00:00:00"),
             link("y1", "edge", "s3", "2024-02-16 00:00:00"), link("y2", "edge", "s4", "2024-02-15 23:59:00"), link("y3", "edge", "s4", "2024-02-16 00:00:01"),
             link("z1", "single", "s5", "2024-02-28 00:00:00"), link("z2", "single", "s5", "2024-02-28 00:00:00"), link("g", "gone", "s0", "2024-02-28 00:00:00")]
    out = {r["id"]: r for r in en.enrich_projects(projects, table(spark, "evidence_links", rows), sessions, ts(NOW)).collect()}

    def facts(key):
        r = out[key]
        return r["status"], round(r["confidence"], 6), round(r["momentum_score"], 6) if r["momentum_score"] is not None else None, r["source_span_count"], r["description"]

    assert facts("busy") == ("active", 0.9, round(4 / 8, 6), 2, "Work across 8 sessions: T0, T1")
    assert facts("stale") == ("stalled", 0.8, 0.0, 1, "Work across 2 sessions: T0")
    assert facts("edge") == ("active", 0.7, 0.5, 2, "Work across 2 sessions: ")
    assert facts("single") == ("speculative", 0.35, 1.0, 1, "Single session: T5")
    assert facts("none") == ("speculative", 0.35, 0.0, 0, None)
    assert out["gone"]["status"] == "archived" and out["gone"]["description"] == "old"


def test_theme_enrichment_rules(spark):
    sessions = table(spark, "sessions", [{"id": f"s{i}", "title": "Same", "source_id": "x"} for i in range(10)])
    themes = table(spark, "themes", [{"id": k, "label": k} for k in ("five", "three", "one", "zero")])
    rows = [link(f"a{i}", "five", f"s{i}", "2024-02-28 00:00:00", "theme") for i in range(5)]
    rows += [link(f"b{i}", "three", f"s{i}", "2024-02-10 00:00:00", "theme") for i in range(3)]
    rows += [link("c", "one", "s1", "2024-02-28 00:00:00", "theme")]
    out = en.enrich_themes(themes, table(spark, "evidence_links", rows), sessions, ts(NOW))
    dash = chr(0x2014)
    assert values(out, "id", "confidence", "recurrence_score", "description") == [
        ("five", 0.75, 0.5, f"Rising {dash} appears in 5 sessions: Same, Same, Same"), ("one", 0.35, 0.1, f"Stable {dash} appears in 1 session"),
        ("three", 0.6, 0.3, f"Declining {dash} appears in 3 sessions: Same, Same, Same"), ("zero", 0.35, 0.0, f"Stable {dash} appears in 1 session"),
    ]
