import itertools
import random
import re
from datetime import datetime, timedelta

import pytest

from helpers import table, ts, values
from talkmill.operators import merging as me
from talkmill.schema import empty_table

AS_OF = "2024-01-31 00:00:00"


def words(text):
    return {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= 2}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def score(p, q):
    """The score of a pair, by its definition."""
    t = jaccard(words(p["canonical_title"]), words(q["canonical_title"]))
    spans = [sorted((x["first"], x["last"])) for x in (p, q)]
    overlap = max(0, min(s[1] for s in spans) - max(s[0] for s in spans))
    union = max(s[1] for s in spans) - min(s[0] for s in spans)
    o = 1.0 if union <= 0 else overlap / union
    if (p["description"] or "").strip() and (q["description"] or "").strip():
        return 0.5 * t + 0.25 * jaccard(words(p["description"]), words(q["description"])) + 0.25 * o
    return 2 / 3 * t + 1 / 3 * o


def made(spark, n, seed, titles=12):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(titles)]
    rows = []
    for i in range(n):
        first = rnd.choice([0, 0, rnd.randrange(40)])
        last = first + rnd.choice([0, 10, 10, rnd.randrange(-5, 30)])
        rows.append({
            "id": f"p{i:03d}", "canonical_title": rnd.choice(["", "!!", " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 5)))]),
            "description": rnd.choice([None, "  ", "?", " ".join(rnd.choices(vocabulary, k=3))]), "status": "active", "first": first, "last": last,
        })
    df = table(spark, "projects", [
        {**{k: r[k] for k in ("id", "canonical_title", "description", "status")},
         "first_seen_at": day(r["first"]), "last_seen_at": day(r["last"])}
        for r in rows
    ])
    return rows, df


def day(n):
    return str(datetime(2024, 1, 10) + timedelta(days=n))


def brute(rows, least, limit):
    pairs = [(-score(a, b), *sorted((a["id"], b["id"]))) for a, b in itertools.combinations(rows, 2)]
    found = sorted((round(s, 9), a, b) for s, a, b in pairs if -s >= least - 1e-12)
    return found if limit is None else found[:limit]


def got(df):
    return sorted((round(-r["score_combined"], 9), r["project_a_id"], r["project_b_id"]) for r in df.collect())


@pytest.mark.parametrize("least,limit", [(0.55, 40), (0.55, 500), (0.55, None), (0.9, 30), (0.51, 3000)])
def test_candidates_equal_all_pairs(spark, least, limit):
    """Blocking, the reduction of equal profiles and the descent over thresholds lose nothing."""
    rows, df = made(spark, 70, 7)
    assert got(me.merge_candidates(df, least, limit)) == brute(rows, least, limit)


def test_many_copies_do_not_pair_up(spark):
    rows, df = made(spark, 60, 3, titles=1)
    assert got(me.merge_candidates(df, 0.55, 10)) == brute(rows, 0.55, 10)
    features = me.scoring_features(df)
    assert me._first_members(features, ["tw", "dw", "lo", "hi"], 3).groupBy("tw", "dw", "lo", "hi").count().agg({"count": "max"}).first()[0] <= 3


def test_newest_projects_only(spark):
    rows, df = made(spark, 40, 5)
    newest = sorted(rows, key=lambda r: (-r["last"], r["id"]))[:10]
    out = me.recompute_candidates(df, ts(AS_OF), max_projects=10)
    assert got(out) == brute(newest, 0.55, 500)


def project(key, status="active"):
    return {"id": key, "canonical_title": key, "status": status}


def link(key, entity, session, message=None, at="2024-01-01 00:00:00", kind="project"):
    return {"id": key, "entity_type": kind, "entity_id": entity, "session_id": session, "message_id": message, "created_at": at}


def test_merge_moves_links_and_drops_doubles(spark):
    projects = table(spark, "projects", [project("a"), project("b"), project("c"), project("z")])
    links = table(spark, "evidence_links", [
        link("a1", "a", "s1"), link("a2", "a", "s1"), link("b1", "b", "s1"), link("b2", "b", "s2", "m", "2024-01-01 00:00:00"),
        link("b3", "b", "s2", "m", "2024-01-02 00:00:00"), link("b4", "b", "s2"), link("t", "b", "s1", kind="theme"), link("z1", "z", "s1"),
    ])
    pairs = spark.createDataFrame([("a", "b"), ("b", "z"), ("c", "z")], "project_a_id string, project_b_id string")
    asked = spark.createDataFrame([("a", "b", 1), ("a", "b", 2)], "surviving_project_id string, merged_project_id string, seq int")
    none = empty_table(spark, "project_merge_decisions")
    out = me.apply_merges(asked, none, projects, links, pairs, ts(AS_OF))
    assert values(out.evidence, "id", "entity_id") == [("a1", "a"), ("a2", "a"), ("b3", "a"), ("b4", "a"), ("t", "b"), ("z1", "z")]
    assert values(out.projects, "id", "status") == [("a", "active"), ("b", "archived"), ("c", "active"), ("z", "active")]
    assert values(out.candidates, "project_a_id", "project_b_id") == [("c", "z")]
    assert out.rejected.count() == 0 and out.decisions.count() == 1
    again = me.apply_merges(asked, out.decisions, out.projects, out.evidence, out.candidates, ts(AS_OF))
    assert again.decisions.count() == 1 and again.rejected.count() == 0
    assert values(again.evidence, "id", "entity_id") == values(out.evidence, "id", "entity_id")
    ids = spark.createDataFrame([("b",), ("c",)], "id string")
    assert values(me.resolve_survivor(ids, out.decisions).fillna("-"), "id", "survivor_id") == [("b", "a"), ("c", "-")]


def test_refused_merges(spark):
    projects = table(spark, "projects", [project(k) for k in "abcdefg"] + [project("x", "archived")])
    prior = table(spark, "project_merge_decisions", [{"surviving_project_id": "a", "merged_project_id": "g"}])
    asked = spark.createDataFrame(
        [("a", "a", 1), ("a", "g", 1), ("b", "g", 1), ("a", "nope", 1), ("x", "b", 1), ("a", "x", 1), ("c", "d", 1), ("d", "e", 1), ("b", "f", 1), ("a", "f", 2)],
        "surviving_project_id string, merged_project_id string, seq int",
    )
    verdicts = values(me.check_merges(asked, prior, projects), "surviving_project_id", "merged_project_id", "verdict")
    assert verdicts == [
        ("a", "a", "same_project"), ("a", "f", "merged_elsewhere"), ("a", "g", "repeat"), ("a", "nope", "unknown_project"),
        ("a", "x", "merged_archived"), ("b", "f", "accept"), ("b", "g", "merged_elsewhere"), ("c", "d", "chained_in_batch"),
        ("d", "e", "chained_in_batch"), ("x", "b", "survivor_archived"),
    ]
