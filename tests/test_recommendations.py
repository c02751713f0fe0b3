from pyspark.sql import functions as F

from helpers import table, ts, values
from talkmill.operators import recommendations as re
from talkmill.schema import empty_table

NOW = "2024-03-01 00:00:00"


def link(key, entity, session, at="2024-01-01 00:00:00", kind="project"):
    return {"id": key, "entity_type": kind, "entity_id": entity, "session_id": session, "message_id": "m" + session, "created_at": at}


def stalled(spark, n, title="P"):
    rows = [(f"p{i}", f"{title}{i}" if i else "Twin", "stalled", 3 + i, 40, f"2024-01-{20 - i} 00:00:00") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, canonical_title string, status string, session_count int, days_since_last_activity int, last_seen_at string")
    return re.stalled_candidates(df.withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp")))


def test_slots_are_cut_before_evidence_is_looked_up(spark):
    links = table(spark, "evidence_links", [link(f"e{i}", f"p{i}", f"s{i}") for i in (1, 2, 5, 6)] + [link("e9", "p1", "s9", "2024-02-01 00:00:00")])
    made = re.generate_recommendations([stalled(spark, 7)], links, empty_table(spark, "recommendations"), ts(NOW))
    assert values(made.recommendations, "title") == [("Resume: P1",), ("Resume: P2",)]
    assert values(made.evidence, "session_id", "message_id", "evidence_score") == [("s2", "ms2", 0.6), ("s9", "ms9", 0.6)]
    assert made.counts.first().asDict() == {"created": 2, "skipped_duplicate": 0}


def test_titles_are_made_once(spark):
    links = table(spark, "evidence_links", [link(f"e{i}", f"p{i}", f"s{i}") for i in range(5)])
    twins = stalled(spark, 2).unionByName(stalled(spark, 1).withColumn("generator", F.lit(4)))
    old = table(spark, "recommendations", [{"id": "o", "title": "Resume: P1", "created_at": NOW}])
    made = re.generate_recommendations([twins], links, old, ts(NOW))
    assert values(made.recommendations, "title") == [("Resume: Twin",)]
    assert made.counts.first().asDict() == {"created": 1, "skipped_duplicate": 2}
    dismissed = old.withColumn("dismissed_at", ts(NOW))
    assert re.generate_recommendations([twins], links, dismissed, ts(NOW)).recommendations.count() == 2


def test_revisit_thresholds_and_texts(spark):
    analytics = spark.createDataFrame(
        [("a", 10, 2000), ("b", 9, 5000), ("c", 12, 12345), ("d", 50, 9000)], "session_id string, message_count int, word_count int"
    )
    sessions = table(spark, "sessions", [
        {"id": "a", "title": " ", "started_at": "2024-01-31 23:00:00"}, {"id": "b", "started_at": "2023-01-01 00:00:00"},
        {"id": "c", "title": "Long", "created_at": "2024-01-02 00:00:00"}, {"id": "d", "title": "New", "started_at": "2024-02-01 00:00:00"},
    ])
    rows = re.revisit_candidates(analytics, sessions, ts(NOW)).orderBy("place").collect()
    assert [(r["title"], round(r["priority_score"], 4)) for r in rows] == [("Revisit: Long", 0.75), ("Revisit: Untitled session", 0.6)]
    assert "from unknown date had 12 messages and 12,345 words" in rows[0]["rationale"] and "from 2024-01-31 had" in rows[1]["rationale"]


def test_consolidation_needs_more_than_the_limit(spark):
    pairs = [("a", "b", 0.6, "x", "y"), ("a", "c", 0.955, "t" * 50, 'q"'), ("b", "c", 0.61, "x", "y"), ("c", "d", 0.62, "x", "y"), ("d", "e", 0.63, "x", "y")]
    listed = spark.createDataFrame(pairs, "project_a_id string, project_b_id string, score_combined double, title_a string, title_b string")
    rows = re.consolidation_candidates(listed).orderBy("place").collect()
    assert [r["entity_id"] for r in rows] == ["a", "d", "c"]
    assert rows[0]["title"] == 'Merge: "' + "t" * 40 + '" and "q""' and "96% similarity" in rows[0]["rationale"] and rows[0]["priority_score"] == 0.9


def test_seed_only_once_and_with_fallback(spark):
    projects = table(spark, "projects", [{"id": "p", "status": "active", "last_seen_at": NOW}, {"id": "q", "status": "archived", "last_seen_at": NOW}])
    sessions = table(spark, "sessions", [{"id": "s", "started_at": "2024-01-01 00:00:00"}, {"id": "r", "created_at": "2023-01-01 00:00:00"}])
    messages = table(spark, "messages", [
        {"id": "m0", "session_id": "s", "role": "system", "sort_order": 0, "content_text": "x"},
        {"id": "m1", "session_id": "s", "role": "user", "sort_order": 1, "content_text": "y" * 300},
    ])
    none, no_links = empty_table(spark, "recommendations"), empty_table(spark, "evidence_links")
    links = table(spark, "evidence_links", [link("e", "p", "s7")])
    assert values(re.seed_recommendation(none, projects, links, sessions, messages, ts(NOW)).evidence, "session_id") == [("s7",)]
    fallback = re.seed_recommendation(none, projects, no_links, sessions, messages, ts(NOW))
    assert values(fallback.evidence, "session_id", "message_id", "excerpt") == [("s", "m1", "y" * 200)]
    old = table(spark, "recommendations", [{"id": "o", "title": "t", "dismissed_at": NOW}])
    assert re.seed_recommendation(old, projects, links, sessions, messages, ts(NOW)).recommendations.count() == 0
    assert re.seed_recommendation(none, projects.filter("id = 'q'"), links, sessions, messages, ts(NOW)).recommendations.count() == 0
    nobody = empty_table(spark, "sessions")
    assert re.seed_recommendation(none, projects, no_links, nobody, messages, ts(NOW)).recommendations.count() == 0


def test_open_sections_and_actions(spark):
    recs = table(spark, "recommendations", [
        {"id": "a", "recommendation_type": "consolidate", "priority_score": 0.5, "created_at": NOW},
        {"id": "b", "recommendation_type": "consolidate", "priority_score": 0.9, "created_at": NOW},
        {"id": "c", "recommendation_type": "next_action", "priority_score": 0.9, "created_at": NOW, "accepted_at": NOW},
    ])
    assert [r["id"] for r in re.open_recommendations(recs).collect()] == ["b", "a"]
    rows = re.recommendations_by_section(recs, table(spark, "evidence_links", [link("e", "a", "s", kind="recommendation")])).collect()
    assert [(r["section_no"], r["id"]) for r in rows] == [(0, None), (1, "b"), (1, "a"), (2, None), (3, None), (4, None), (5, None)]
    actions = spark.createDataFrame([("a", "dismiss"), ("b", "accept"), ("zz", "accept")], "id string, action string").withColumn("at", ts(NOW))
    after = re.apply_actions(recs, actions)
    assert re.open_recommendations(after).count() == 0 and after.filter("accepted_at is not null").count() == 2
