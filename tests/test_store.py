"""The store's log, the stored index, the day trend, resumed maintenance and nearest vectors."""

import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import table, ts, values
from talkmill.operators import embeddings as em
from talkmill.operators import search as se
from talkmill.operators import segments as sg
from talkmill.plans import queries_store as qs
from talkmill.plans import testbed
from talkmill.plans.maintenance import resume_maintenance
from talkmill.schema import TABLES, empty_table
from talkmill.sources.store import TableStore
from talkmill.streaming import trend as tr
from talkmill.streaming.ingest import ingest_batch


def themes(spark, *ids):
    return table(spark, "themes", [{"id": i, "label": i} for i in ids])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_readers_see_committed_runs_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.read("themes").count() == 0 and not store.has("themes")
    with pytest.raises(ZeroDivisionError), store.begin("0") as run:
        run.write("themes", themes(spark, "a"))
        1 / 0
    assert store.read("themes").count() == 0 and not store.committed("0")
    with store.begin("0") as run:
        run.write("themes", themes(spark, "a", "b"))
        run.write("own", spark.range(3))
        assert ids(run.read("themes")) == ["a", "b"] and store.read("themes").count() == 0
    old = store.at()
    assert (ids(store.read("themes")), store.read("own").count()) == (["a", "b"], 3)
    with store.begin("0") as run:  # a second try replaces every table of the first
        run.write("themes", themes(spark, "c"))
    assert (ids(store.read("themes")), store.has("own"), ids(old.read("themes")), old.read("own").count()) == (["c"], False, ["a", "b"], 3)
    with pytest.raises(KeyError):
        store.read("own")


def test_compaction_keeps_runs_apart(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    for run in range(4):
        store.write("themes", themes(spark, f"t{run}", f"u{run}"), str(run))
    before = store.state()
    store.compact("themes", files=2)
    assert len(store.state()["tables"]["themes"]) == 1
    assert ids(store.read("themes", before=2)) == ["t0", "t1", "u0", "u1"] and ids(store.read("themes", run="3")) == ["t3", "u3"]
    store.write("themes", themes(spark, "new"), "1")
    assert ids(store.read("themes")) == ["new", "t0", "t2", "t3", "u0", "u2", "u3"] and ids(store.read("themes", run="1")) == ["new"]
    with pytest.raises(RuntimeError):
        store.replace({"themes": store.read("themes", with_run=True)}, before)
    gone = store.vacuum()
    assert len(gone) == 5 and store.vacuum() == [] and store.read("themes").count() == 7


def test_a_commit_that_broke_off_does_not_count(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    store.write("themes", themes(spark, "a"), "0")
    log = tmp_path / "s" / "_log"
    (log / f"{2:020d}.json").write_text('{"version": 2, "tab')
    assert ids(store.read("themes")) == ["a"]
    store.write("themes", themes(spark, "b"), "1")
    assert ids(store.read("themes")) == ["a", "b"] and store.state()["version"] == 3


def chunks(spark, **texts):
    return table(spark, "chunks", [{"id": k, "session_id": "s", "message_id": "m", "text": v} for k, v in texts.items()])


def ranked(index, spark, text):
    asked = spark.createDataFrame([("q", text)], "query_id string, text string")
    return sorted((r["chunk_id"], round(r["rank"], 9)) for r in se.match_chunks(index, asked).collect())


def test_segments_search_like_a_fresh_index(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    now = {}

    def step(run, added, gone=()):
        with store.begin(str(run)) as staged:
            if gone:
                sg.delete_chunks(staged, spark.createDataFrame([(g,) for g in [*gone, gone[0], "never"]], "chunk_id string"))
            sg.add_segment(staged, chunks(spark, **added) if added else empty_table(spark, "chunks"))
        for g in gone:
            del now[g]
        now.update(added)
        same()

    def same():
        fresh = se.build_text_index(chunks(spark, **now))
        held = sg.read_index(store.at())
        for text in ("foo", "foo bar", "foo-bar", "nothing"):
            assert ranked(held, spark, text) == ranked(fresh, spark, text), text

    step(0, {"a": "foo bar", "b": "bar foo foo", "c": "x y z"})
    step(1, {"d": "foo-bar foo bar"})
    step(2, {"e": "foo"}, ["a", "d"])
    step(3, {"a": "foo foo bar again", "b": "bar"}, ["b"])
    sg.merge_segments(store)
    assert not store.has(sg.DELETED) and len(store.state()["tables"][sg.DOCS]) == 1
    same()
    step(4, {}, ["a", "e"])


def test_deletions_leave_the_segments_where_they_are(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "s"))
    with store.begin("0") as staged:
        sg.add_segment(staged, chunks(spark, a="foo bar", b="foo", c="bar"))
    with store.begin("1") as staged:
        sg.delete_chunks(staged, spark.createDataFrame([("a",)], "chunk_id string"))
    read = lambda: sg.read_index(store.at()).lists
    shuffled = lambda: "SortMergeJoin" in read()._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else Spark sends so small a table by itself
    try:
        assert not shuffled() and ids(read().withColumnRenamed("chunk_id", "id")) == ["b", "c"]
        monkeypatch.setattr(sg, "GONE_BYTES", 0)  # more ids than are sent to all tasks
        assert shuffled() and ids(read().withColumnRenamed("chunk_id", "id")) == ["b", "c"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_import_and_its_index_become_visible_together(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("x/a.md", "## User\nhello garden\n")], "file_name string, content string")

    def breaks(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ingest_batch(store, files, 0, ts("2024-06-01 00:00:00"), extraction=breaks)
    assert store.state()["tables"] == {}
    for _ in range(2):
        ingest_batch(store, files, 0, ts("2024-06-01 00:00:00"))
    assert store.state()["version"] == 1 and len(ranked(sg.read_index(store), spark, "garden")) == 1


def test_days_close_by_event_time(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        tr.write_arrivals(rows, F.col("t").cast("timestamp"), folder)
        tr.trend_stream(spark, folder, out, state)

    seen = lambda: [(str(d), n) for d, n in values(tr.closed_days(spark, out), "day", "count")]
    arrive("2024-01-01 10:00:00", "2024-01-01 23:59:59", "2024-01-02 00:00:00")
    assert seen() == []
    arrive("2024-01-03 12:00:00", "2024-01-01 08:00:00")  # the second is late, but its day is open
    assert seen() == [("2024-01-01", 3)]
    arrive("2024-01-01 09:00:00", "2024-01-02 09:00:00")  # the first is too late
    tr.close_days(spark, folder, ts("2024-01-09 00:00:00"))
    tr.trend_stream(spark, folder, out, state)
    assert seen() == [("2024-01-01", 3), ("2024-01-02", 2), ("2024-01-03", 1)]
    tr.trend_stream(spark, folder, out, state)
    assert len(seen()) == 3


def test_maintenance_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from talkmill.plans import maintenance as mt

    store = TableStore(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("x/a.md", "## User\nhello garden\n## Assistant\nyes\n")], "file_name string, content string")
    ingest_batch(store, files, 0, ts("2024-06-01 00:00:00"), extraction=None)
    apply_stage = mt.apply_stage

    def breaks(stage, *args):
        if stage == "analytics":
            raise RuntimeError("lost")
        return apply_stage(stage, *args)

    monkeypatch.setattr(mt, "apply_stage", breaks)
    with pytest.raises(RuntimeError):
        resume_maintenance(store, "m", ts("2024-06-01 00:00:00"))
    monkeypatch.setattr(mt, "apply_stage", apply_stage)
    more = spark.createDataFrame([("x/b.md", "## User\nanother\n")], "file_name string, content string")
    ingest_batch(store, more, 1, ts("2024-06-02 00:00:00"), extraction=None)
    done, ran = resume_maintenance(store, "m", ts("2024-06-01 00:00:00"))
    assert ran[0] == "analytics" and set(done) == set(TABLES)
    assert (done["sessions"].count(), done["session_analytics"].count(), done["projects"].count()) == (1, 1, 1)
    assert resume_maintenance(store, "m", ts("2024-06-01 00:00:00"))[1] == []
    assert resume_maintenance(store, "n", ts("2024-06-02 00:00:00"))[0]["session_analytics"].count() == 2


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(f"v{i:03d}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    vectors += [(f"w{i}", vectors[i][1]) for i in range(20)] + [("none", None), ("empty", []), ("zero", [0.0] * 8), ("short", [1.0, 2.0])]
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(9)] + [("q-short", [2.0, 4.0]), ("q-none", None), ("q0-copy", vectors[0][1])]
    schema = "id string, embedding array<double>"
    monkeypatch.setattr(em, "ASKING_BLOCK", 4)
    monkeypatch.setattr(em, "ASKED_BLOCK", 16)
    monkeypatch.setattr(em, "PRODUCT_ROWS", 7)
    found = em.nearest(spark.createDataFrame(queries, schema).repartition(2), spark.createDataFrame(vectors, schema).repartition(3), 12, lanes=3)
    got = {}
    for r in found.orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["cosine"], 9) + 0.0))
    for q, asked in queries:
        want = sorted(((v, round(cosine(asked, held), 9) + 0.0) for v, held in vectors), key=lambda x: (-x[1], x[0]))[:12]
        assert got[q] == want, q
    none = spark.createDataFrame([], schema)
    assert em.nearest(none, spark.createDataFrame(vectors, schema), 3).count() == 0
    assert em.nearest(spark.createDataFrame(queries, schema), none, 3).count() == 0


def test_an_export_puts_many_conversations_into_a_file(spark, tmp_path):
    said = {c: [f'{c} "a"\n[1]', "  ", f"] é {c}"] for c in range(1, 200)}
    rows = [(c, turn, "user" if turn % 2 == 0 else "assistant", text) for c, texts in said.items() for turn, text in enumerate(texts)]
    spark.createDataFrame(rows[::-1], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "sf/conversations.parquet"))
    inbox, t = tmp_path / "inbox", testbed.Testbed(spark, str(tmp_path / "sf"))
    first = None
    for where in ("conv_id % 3 = 0", "conv_id % 3 <> 0"):
        qs._export(t, where, str(inbox))
        files = sorted(inbox.glob("part-*"))
        first = first or files
    assert set(first) < set(files) and all(f.suffix == ".json" for f in files) and 2 < len(files) <= 2 * qs.LEAST_FILES
    chats = {chat["title"]: [m["content"] for m in chat["messages"]] for f in files for chat in json.loads(f.read_text())}
    assert chats == {f"Chat {c}": texts for c, texts in said.items()}
    assert sum(len(json.loads(f.read_text())) for f in files) == len(said)
