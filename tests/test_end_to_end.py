"""From files to recommendations: streaming import, then the maintenance run."""

import json

from pyspark.sql import functions as F

from helpers import table, ts, values
from talkmill.operators.chunks import reindex_stale
from talkmill.plans.maintenance import run_maintenance
from talkmill.schema import TABLES, empty_table
from talkmill.sources.store import TableStore
from talkmill.streaming.ingest import ingest_batch, ingest_stream

NOW = "2024-06-01 00:00:00"


def chat(title, *texts, start=1704067200):
    nodes = {"r": {"id": "r", "children": ["n0"]}}
    for i, text in enumerate(texts):
        nodes[f"n{i}"] = {
            "id": f"n{i}", "parent": "r" if i == 0 else f"n{i - 1}", "children": [f"n{i + 1}"] if i + 1 < len(texts) else [],
            "message": {"id": f"m{i}", "author": {"role": "user" if i % 2 == 0 else "assistant"}, "create_time": start + 60 * i,
                        "content": {"content_type": "text", "parts": [text]}},
        }
    return {"title": title, "create_time": start, "mapping": nodes}


def counts(store):
    names = ("sources", "import_batches", "sessions", "messages", "artifacts", "chunks", "projects", "evidence_links", "parse_warnings")
    return {n: store.read(n).count() for n in names}


def test_stream_takes_new_files_only(spark, tmp_path):
    inbox, store = tmp_path / "in", TableStore(spark, str(tmp_path / "store"))
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps([chat("Garden plan", "grow beans", "sure\n```sql\nselect 1\n```"), chat("Other", "hi")]))
    (inbox / "b.md").write_text("## User\nhello\n## Assistant\nhi\n")
    state = str(tmp_path / "state")
    ingest_stream(spark, str(inbox), store, state).awaitTermination()
    first = counts(store)
    assert first == {"sources": 2, "import_batches": 2, "sessions": 3, "messages": 5, "artifacts": 1, "chunks": 6, "projects": 3,
                     "evidence_links": 3, "parse_warnings": 0}
    ingest_stream(spark, str(inbox), store, state).awaitTermination()
    assert counts(store) == first
    (inbox / "copy.md").write_text("## User\nhello\n## Assistant\nhi\n")
    (inbox / "c.md").write_text("## User\nnew words\n")
    ingest_stream(spark, str(inbox), store, state).awaitTermination()
    assert counts(store) == {**first, "import_batches": 3, "sessions": 4, "messages": 6, "chunks": 7, "projects": 4, "evidence_links": 4,
                             "parse_warnings": 1}
    assert store.read("chunks").filter(F.size("embedding") == 64).count() == 7


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("x/a.md", "## User\nhello\n")], "file_name string, content string")
    for _ in range(2):
        ingest_batch(store, files, 0, ts(NOW))
    assert counts(store)["sessions"] == 1 and counts(store)["sources"] == 1


def test_maintenance_fills_every_table_and_settles(spark, tmp_path):
    texts = ["plan the garden beds " * 60] * 12
    files = spark.createDataFrame(
        [(f"e/{i}.json", json.dumps([chat("Garden plan", *texts, f"end {i}")])) for i in range(4)], "file_name string, content string"
    )
    store = TableStore(spark, str(tmp_path / "store"))
    ingest_batch(store, files, 0, ts(NOW), extraction=None)
    tables = {n: store.read(n) for n in TABLES}
    tables["import_batches"] = tables["import_batches"].withColumn("search_index_version", F.lit(0))
    tables["chunks"] = tables["chunks"].limit(1).withColumn("text", F.lit("outdated"))
    snapshots = TableStore(spark, str(tmp_path / "snap"))

    def keep_as(prefix):
        def keep(stage, name, df):
            snapshots.write(f"{prefix}-{stage}-{name}", df, "0")
            return snapshots.read(f"{prefix}-{stage}-{name}")

        return keep

    done = run_maintenance(tables, ts(NOW), keep_as("a"), recompute_merges=True)
    assert done["chunks"].filter("text = 'outdated'").count() == 0
    assert done["chunks"].count() == 52 and done["chunks"].filter("embedding is null").count() == 0
    assert values(done["import_batches"].select("search_index_version").distinct(), "search_index_version") == [(1,)]
    assert (done["projects"].count(), done["themes"].count(), done["session_analytics"].count()) == (4, 1, 4)
    assert done["project_merge_candidates"].count() == 6
    assert done["themes"].first()["recurrence_score"] == 1.0
    kinds = dict(values(done["recommendations"].groupBy("recommendation_type").count(), "recommendation_type", "count"))
    assert kinds == {"next_action": 1, "consolidate": 1, "revisit_decision": 1}
    linked = done["evidence_links"].filter("entity_type = 'recommendation'").select(F.col("entity_id").alias("id"))
    assert done["recommendations"].join(linked, "id", "left_anti").count() == 0

    again = run_maintenance(done, ts(NOW), keep_as("b"), recompute_merges=True)
    for name in ("chunks", "projects", "themes", "session_analytics", "recommendations", "evidence_links", "project_merge_candidates"):
        assert again[name].count() == done[name].count(), name


def test_reindex_leaves_other_sessions_alone(spark):
    batches = table(spark, "import_batches", [
        {"id": "old", "status": "completed", "search_index_version": 0}, {"id": "new", "status": "completed", "search_index_version": 1},
        {"id": "bad", "status": "failed", "search_index_version": 0},
    ])
    sessions = table(spark, "sessions", [{"id": "s1", "import_batch_id": "old"}, {"id": "s2", "import_batch_id": "new"}, {"id": "s3", "import_batch_id": "bad"}])
    messages = table(spark, "messages", [{"id": "m" + s, "session_id": s, "content_text": "fresh", "sort_order": 0} for s in ("s1", "s2", "s3")])
    chunks = table(spark, "chunks", [{"id": "c" + s, "session_id": s, "text": "stale"} for s in ("s1", "s2", "s3")])
    out, raised = reindex_stale(batches, sessions, messages, empty_table(spark, "artifacts"), chunks)
    assert values(out, "session_id", "text") == [("s1", "fresh"), ("s2", "stale"), ("s3", "stale")]
    assert values(raised, "id", "search_index_version") == [("bad", 0), ("new", 1), ("old", 1)]
