import json

from pyspark.sql import functions as F

from helpers import table, ts, values
from talkmill.operators import profile as pf
from talkmill.schema import empty_table

NOW = "2024-03-01 00:00:00"


def answers(spark, *texts):
    return spark.createDataFrame([(i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "batch_no int, response string")


def trait(label, confidence=0.5, ids=(), **more):
    return {"label": label, "confidence": confidence, "evidence_session_ids": list(ids), **more}


def test_responses_are_checked_and_defaulted(spark):
    good = {"summary": "s", "strengths": ["a", 1], "work_style": 3, "traits": [
        {}, trait("x", 7, ["s1", 2, None]), trait(5, "high", impact_score=-1), "no", None, {"evidence_session_ids": "s1", "confidence": None}]}
    profiles, traits = pf.parse_profile_responses(answers(spark, "nope", {"summary": 1, "traits": []}, {"summary": "x"}, good))
    assert values(profiles, "batch_no", "strengths", "growth_areas", "work_style") == [(3, ["a"], [], "Unknown")]
    assert values(traits, "trait_no", "label", "category", "confidence", "impact_score", "evidence_session_ids") == [
        (0, "Unknown pattern", "behavioral", 0.3, 0.3, []), (1, "x", "behavioral", 1.0, 0.3, ["s1"]), (2, "5", "behavioral", 0.3, 0.0, []),
        (3, "Unknown pattern", "behavioral", 0.3, 0.3, []),
    ]


def merged(spark):
    one = {"summary": "1", "traits": [trait("Deep focus", 0.5, ["s1", "s2"], category="workflow"), trait("Other", 0.9, ["zz"], category="odd")]}
    two = {"summary": "2", "traits": [trait(" deep Focus", 0.8, ["s2", "s3"]), trait("deep focus", 0.8, [f"s{i}" for i in range(20)])]}
    profiles, traits = pf.parse_profile_responses(answers(spark, one, two, "{"))
    return profiles, *pf.merge_traits(traits)


def test_traits_patterns_and_links(spark):
    profiles, traits, ids = merged(spark)
    assert values(traits, "label_key", "label", "confidence") == [("deep focus", " deep Focus", 0.8), ("other", "Other", 0.9)]
    order = [r["session_id"] for r in ids.filter("label_key = 'deep focus'").orderBy("first").collect()]
    assert order[:5] == ["s1", "s2", "s3", "s0", "s4"] and len(order) == 20
    old = table(spark, "patterns", [
        {"id": "k", "label": "Other", "category": "temporal", "confidence": 0.1, "first_seen_at": "2020-01-01 00:00:00"},
        {"id": "z", "label": "Other", "category": "temporal", "confidence": 0.2}, {"id": "u", "label": "Untouched", "confidence": 0.3},
    ])
    patterns = pf.upsert_patterns(old, traits, ts(NOW))
    assert values(patterns.fillna("-"), "label", "category", "confidence") == [
        (" deep Focus", "behavioral", 0.8), ("Other", "temporal", 0.2), ("Other", "temporal", 0.9), ("Untouched", "-", 0.3),
    ]
    sessions = table(spark, "sessions", [{"id": f"s{i}"} for i in range(1, 20)])
    links = pf.pattern_evidence(traits, ids, patterns, sessions, ts(NOW))
    assert sorted(r["session_id"] for r in links.collect()) == sorted(["s1", "s2", "s3", *[f"s{i}" for i in range(4, 11)]])
    assert values(pf.profile_row(profiles, sessions, "m", ts(NOW)), "summary", "session_count_at_computation") == [("2", 19)]
    assert pf.profile_row(profiles.filter("false"), sessions, "m", ts(NOW)).count() == 0
    listed = pf.pattern_list(patterns, links)
    assert listed.collect()[0]["label"] == "Other" and listed.count() == 13
    assert pf.pattern_list(patterns, links, "temporal").count() == 2


def test_numbers_are_exact_over_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k")).repartition(13)
    got = pf.numbered(rows, [F.desc("k"), F.col("n")], "no").orderBy("no").collect()
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert [(r["no"], r["n"]) for r in got] == [(i, n) for i, (_, n) in enumerate(want)]


def test_digests_and_batches(spark):
    sessions = table(spark, "sessions", [{"id": f"s{i}", "started_at": None if i == 0 else f"2024-01-0{i} 00:00:00", "title": "T"} for i in range(5)])
    messages = table(spark, "messages", [{"id": "m", "session_id": "s1", "role": "user", "sort_order": 0, "content_text": "w" * 200}])
    analytics = spark.createDataFrame(
        [("s1", 1, 1, 0, 9, 1.5, list("abcdefghij"))],
        "session_id string, message_count int, user_msg_count int, assistant_msg_count int, word_count int, duration_minutes double, top_keywords array<string>",
    )
    linked = spark.createDataFrame([("s1", "project", f"p{i}", f"L{i}") for i in range(7)], "session_id string, entity_type string, entity_id string, label string")
    digests = pf.session_digests(sessions, messages, analytics, linked)
    first = digests.filter("session_id = 's1'").first()
    assert (first["project_count"], first["linked_projects"], len(first["first_user_snippet"])) == (7, [f"L{i}" for i in range(7)], 150)
    batches = pf.digest_batches(digests, 2).orderBy("batch_no").collect()
    ids = [[d["id"] for d in json.loads(b["digests"])] for b in batches]
    assert ids == [["s4", "s3"], ["s2", "s1"], ["s0"]]
    digest = json.loads(batches[1]["digests"])[1]
    assert digest["projects"] == ["L0", "L1", "L2", "L3", "L4"]
    assert digest["keywords"] == list("abcdefgh") and digest["date"] == "2024-01-01T00:00:00.000Z" and json.loads(batches[2]["digests"])[0]["date"] is None


def test_prompts_and_topics(spark):
    sessions = table(spark, "sessions", [{"id": "s", "title": None}, {"id": "t", "title": "T"}])
    messages = table(spark, "messages", [
        {"id": str(i), "session_id": "s", "role": "user" if i % 2 else "tool", "sort_order": i, "content_text": f"{i}" * 300} for i in range(30)
    ])
    rows = dict(values(pf.prompt_messages(sessions, messages), "session_id", "user_messages"))
    assert rows["t"] == "" and [p[0] for p in rows["s"].split("\n")] == list("1357911111") and max(map(len, rows["s"].split("\n"))) == 200
    topics = spark.createDataFrame([("a", '["x",1,"y"]'), ("b", '{"topics":["z"]}'), ("c", '{"topics":"z"}'), ("d", "["), ("e", json.dumps([str(i) for i in range(12)]))], "session_id string, response string")
    got = dict(values(pf.parse_topics(topics), "session_id", "topics"))
    assert got == {"a": ["x", "y"], "b": ["z"], "c": [], "d": [], "e": [str(i) for i in range(10)]}
    projects = table(spark, "projects", [{"id": "p", "canonical_title": "P"}, {"id": "q", "canonical_title": "Q"}])
    links = table(spark, "evidence_links", [{"id": "e", "entity_type": "project", "entity_id": "p", "session_id": "t", "created_at": NOW}])
    assert values(pf.prompt_titles(projects, links, sessions), "id", "session_titles") == [("p", "T"), ("q", "")]
    assert pf.upsert_patterns(empty_table(spark, "patterns"), merged(spark)[1], ts(NOW)).count() == 2
