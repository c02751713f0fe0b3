from datetime import date

from pyspark.sql import functions as F

from helpers import one, table, ts, values
from talkmill.operators import analytics as an
from talkmill.operators import dashboards as da
from talkmill.operators import provenance as pr


def msg(session, order, text="x", role="user", at=None):
    return {"id": f"{session}-{order}", "session_id": session, "role": role, "content_text": text, "sort_order": order, "timestamp": at}


def test_duration_rules(spark):
    t = "2024-01-01 00:00:"
    sessions = table(spark, "sessions", [
        {"id": "fall", "started_at": t + "00", "ended_at": "2024-01-01 00:10:03"}, {"id": "one"}, {"id": "same"}, {"id": "back"},
        {"id": "none"}, {"id": "order"},
    ])
    messages = table(spark, "messages", [
        msg("fall", 0), msg("fall", 1), msg("one", 0, at=t + "00"), msg("same", 0, at=t + "05"), msg("same", 1, at=t + "05"),
        msg("back", 0, at=t + "09"), msg("back", 1, at=t + "01"), msg("order", 5, at=t + "59", role="assistant"), msg("order", 2, at=t + "00"),
        msg("order", 3, "a b" + chr(0xA0) + "c", at="2024-01-03 00:00:00", role="system"),
    ])
    rows = {r["session_id"]: r for r in an.session_metrics(sessions, messages).collect()}
    assert {k: r["duration_minutes"] for k, r in rows.items()} == {
        "fall": 10.1, "one": None, "same": None, "back": None, "none": None, "order": 1.0,
    }
    assert rows["none"]["message_count"] == rows["none"]["word_count"] == 0
    o = rows["order"]
    assert (o["message_count"], o["user_msg_count"], o["assistant_msg_count"], o["word_count"]) == (3, 1, 1, 5)


def test_keywords_break_ties_by_first_occurrence(spark):
    messages = table(spark, "messages", [
        msg("s", 2, "zebra apple 123 the zebra-crossing"), msg("s", 1, "mango apple ab don't isn't mango's"), msg("t", 0, "the a 42"),
    ])
    got = dict(values(an.top_keywords(messages), "session_id", "top_keywords"))
    assert got == {"s": ["apple", "mango", "mango's", "zebra", "zebra-crossing"]}
    many = table(spark, "messages", [msg("s", 0, " ".join(f"word{i:02d}x" for i in range(30)))])
    assert one(an.top_keywords(many), "top_keywords") == [f"word{i:02d}x" for i in range(15)]
    assert one(an.top_keywords(messages, 1, ["apple"]).filter("session_id = 's'"), "top_keywords") == ["mango"]


def test_update_adds_only_new_sessions(spark):
    sessions = table(spark, "sessions", [{"id": "a"}, {"id": "b"}])
    messages = table(spark, "messages", [msg("a", 0, "alpha"), msg("b", 0, "beta")])
    old = an.compute_session_analytics(sessions.filter("id = 'a'"), messages.filter("session_id = 'a'"), ts("2024-01-01"))
    new = an.update_session_analytics(old, sessions, messages.withColumn("content_text", F.lit("gamma delta")), ts("2024-02-01"))
    assert values(new, "session_id", "word_count") == [("a", 1), ("b", 2)]
    assert an.update_session_analytics(new, sessions, messages, ts("2024-03-01")).count() == 2
    fresh = an.update_session_analytics(new, sessions, messages, ts("2024-03-01"), refresh=True)
    assert values(fresh, "session_id", "word_count") == [("a", 1), ("b", 1)]


def test_profiles_read_old_keyword_text(spark):
    df = spark.createDataFrame(
        [("a", 1, '["x",3,"y"]'), ("b", None, "oops"), ("c", 2, None)], "session_id string, message_count int, top_keywords_json string"
    )
    for c in ("user_msg_count", "assistant_msg_count", "word_count", "duration_minutes"):
        df = df.withColumn(c, F.lit(None).cast("int"))
    assert values(an.session_profiles(df), "session_id", "message_count", "top_keywords") == [("a", 1, ["x", "y"]), ("b", 0, []), ("c", 2, [])]


def test_trend_bounds_and_series(spark):
    days = ["2024-01-17 00:00:00", "2024-01-16 23:59:59", "2024-01-31 12:00:00", "2024-02-09 00:00:00"]
    sessions = table(spark, "sessions", [{"id": str(i), "created_at": d, "started_at": d if i else None} for i, d in enumerate(days)])
    trend = da.activity_trend(sessions, ts("2024-01-31 05:00:00"), 14)
    assert [(str(r["day"]), r["count"]) for r in trend.collect()] == [("2024-01-17", 1), ("2024-01-31", 1), ("2024-02-09", 1)]
    series = da.activity_series(sessions, date(2024, 1, 31), 14).collect()
    assert len(series) == 14 and str(series[0]["day"]) == "2024-01-18" and series[-1]["count"] == 1 and series[0]["total"] == 3


def evidence(spark, *rows):
    names = ("id", "entity_type", "entity_id", "session_id", "created_at", "message_id")
    return table(spark, "evidence_links", [dict(zip(names, r)) for r in rows])


def test_theme_trend_uses_calendar_days_and_a_margin(spark):
    themes = table(spark, "themes", [{"id": "up", "label": "u"}, {"id": "flat", "label": "f"}, {"id": "down", "label": "d"}, {"id": "idle", "label": "i"}])
    rows = [("a1", "theme", "up", "s1", "2024-01-17 00:00:00"), ("a2", "theme", "up", "s1", "2024-01-20 00:00:00"),
            ("b1", "theme", "flat", "s1", "2024-01-30 00:00:00"), ("b2", "theme", "flat", "s2", "2024-03-01 00:00:00"),
            ("b3", "theme", "flat", "s3", "2024-01-16 23:00:00"), ("c1", "theme", "down", "s1", "2024-01-03 00:00:00"),
            ("c2", "theme", "down", "s1", "2024-01-16 00:00:00"), ("c3", "theme", "down", "s2", "2024-01-02 23:59:59"),
            ("x", "project", "up", "s9", "2024-01-20 00:00:00")]
    got = da.theme_recurrence(themes, evidence(spark, *rows), ts("2024-01-31 18:00:00"))
    assert values(got, "id", "session_count", "recent_count", "prior_count", "trend") == [
        ("down", 2, 0, 2, "declining"), ("flat", 3, 2, 1, "stable"), ("idle", 0, 0, 0, "stable"), ("up", 1, 2, 0, "rising"),
    ]
    assert [r["id"] for r in da.theme_list(got, "name").collect()] == ["down", "flat", "idle", "up"]
    assert [r["id"] for r in da.theme_list(got, limit=1).collect()] == ["flat"]


def test_activity_levels(spark):
    def p(key, last, momentum=None, status="active"):
        return {"id": key, "canonical_title": key, "status": status, "last_seen_at": last, "momentum_score": momentum}

    projects = table(spark, "projects", [
        p("seven", "2024-01-23 13:00:00"), p("eight", "2024-01-22 12:00:00"), p("thirty", "2023-12-31 20:00:00", 0.2),
        p("old", "2023-01-01 00:00:00"), p("old_hot", "2023-01-01 00:00:00", 0.51), p("old_warm", "2023-01-01 00:00:00", 0.21),
        p("future", "2024-02-01 00:00:00"), p("gone", "2024-01-30 00:00:00", status="archived"), p("null", None),
    ])
    rows = da.project_activity(projects, evidence(spark, ("e", "project", "old", "s1", "2024-01-01 00:00:00")), ts("2024-01-31 12:00:00"))
    got = {r["id"]: (r["activity_level"], r["days_since_last_activity"], r["evidence_count"]) for r in rows.collect()}
    assert got == {
        "seven": ("hot", 7, 0), "eight": ("warm", 9, 0), "thirty": ("warm", 30, 0), "old": ("cold", 395, 1), "old_hot": ("hot", 395, 0),
        "old_warm": ("warm", 395, 0), "future": ("hot", 0, 0), "null": ("cold", 999, 0),
    }
    assert [r["id"] for r in da.top_active_projects(rows, 2).collect()] == ["old_hot", "future"]
    assert da.project_activity(projects, evidence(spark), ts("2024-01-31"), include_archived=True).count() == 9
    assert [r["id"] for r in da.project_list(rows, order="name").collect()][0] == "eight"


def test_provenance(spark):
    links = evidence(spark, ("e1", "theme", "t1", "s1", "2024-01-01 00:00:00", "m1"), ("e2", "theme", "t1", "s2", "2024-01-02 00:00:00", "m9"),
                     ("e3", "theme", "t9", "s1", "2024-01-03 00:00:00", None))
    themes = table(spark, "themes", [{"id": "t1", "label": "x"}, {"id": "t2", "label": "y"}])
    sessions = table(spark, "sessions", [{"id": "s1", "title": "A"}])
    messages = table(spark, "messages", [{"id": "m1"}])
    audit = pr.provenance_audit(links, {"theme": themes}, sessions, messages)
    assert values(audit, "problem", "ref_id") == [
        ("entity_without_evidence", "t2"), ("missing_entity", "t9"), ("missing_message", "m9"), ("missing_session", "s2"),
    ]
    assert [r["id"] for r in pr.evidence_for(links, "theme", themes).collect()] == ["e2", "e1"]
    assert [r["id"] for r in pr.evidence_of_sessions(links, sessions).collect()] == ["e3", "e1"]
    assert values(pr.latest_evidence(links, "theme", themes), "session_id", "message_id") == [("s2", "m9")]
    assert pr.entity_detail(themes, "theme", "label", links, sessions).count() == 2


def test_reading_view_keeps_orphans(spark):
    sessions = table(spark, "sessions", [{"id": "s"}])
    messages = table(spark, "messages", [msg("s", 0), msg("s", 1), msg("other", 0)])
    artifacts = table(spark, "artifacts", [
        {"id": "a1", "session_id": "s", "message_id": "s-1", "content_text": "c"}, {"id": "a2", "session_id": "s", "content_text": "c"},
    ])
    assert values(da.session_detail(sessions, messages, artifacts).fillna(-1, ["sort_order"]), "part", "sort_order") == [
        ("artifact", 1), ("message", 0), ("message", 1), ("orphan_artifact", -1),
    ]
