"""Queries of the store, the stored index, the streams and the resumable maintenance run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators import search as se
from talkmill.operators import segments as sg
from talkmill.operators.chunks import build_chunks
from talkmill.plans.maintenance import STAGES, resume_maintenance
from talkmill.plans.oracle_views import sql_round, sql_strip, sql_terms, with_views
from talkmill.plans.queries_search import SEARCH_VIEWS, hits_sql, searches
from talkmill.plans.registry import query
from talkmill.plans.testbed import Testbed, as_of, new_store
from talkmill.schema import empty_table
from talkmill.streaming import trend as tr
from talkmill.streaming.ingest import ingest_batch, ingest_stream


@query(
    "store_snapshots",
    with_views(
        """SELECT 'first' AS snapshot, id, coalesce(title, '-') AS title FROM v_sessions WHERE id::bigint % 3 = 0
           UNION ALL SELECT 'before run 2', id, coalesce(title, '-') FROM v_sessions WHERE id::bigint % 3 < 2
           UNION ALL SELECT 'now', id, CASE WHEN id::bigint % 3 = 1 THEN 'again ' || id ELSE coalesce(title, '-') END FROM v_sessions"""
    ),
)
def store_snapshots(t: Testbed) -> DataFrame:
    """A store with a replaced run, compaction, a run replaced after it, and a try that was never committed."""
    store = new_store(t.spark, "store")
    part = lambda n: t.sessions.filter(F.col("id").cast("bigint") % 3 == n)
    store.write("sessions", part(0), "0")
    first = store.at()
    store.write("sessions", part(2), "1")
    store.write("sessions", part(1), "1")
    before = store.at()
    store.write("sessions", part(2), "2")
    store.begin("3").write("sessions", t.sessions)
    store.compact("sessions")
    early = store.read("sessions", before=2)
    store.write("sessions", part(1).withColumn("title", F.concat(F.lit("again "), "id")), "1")
    shown = lambda name, rows: rows.select(F.lit(name).alias("snapshot"), "id", F.coalesce("title", F.lit("-")).alias("title"))
    assert before.read("sessions", run="1").schema == early.schema
    return shown("first", first.read("sessions")).unionByName(shown("before run 2", early)).unionByName(shown("now", store.read("sessions")))


GONE = "(session_id::bigint % 10 = 3 AND session_id <> '13')"
LIVE_VIEWS = {
    k: v.replace("v_chunks", f"(SELECT * FROM v_chunks WHERE NOT {GONE}) v_live") for k, v in SEARCH_VIEWS.items()
}


@query("index_lifecycle", with_views(f"SELECT query_id, chunk_id, session_id, {sql_round('rank')} AS rank, position FROM ({hits_sql(30)})", LIVE_VIEWS))
def index_lifecycle(t: Testbed) -> DataFrame:
    """Searches of an index that chunks were added to, deleted from and given back to, with segments merged on the way."""
    store = new_store(t.spark, "index")
    of = lambda c: t.chunks.filter(c)
    gone = F.col("session_id").cast("bigint") % 10 == 3
    with store.begin("0") as run:
        sg.add_segment(run, of("artifact_id IS NOT NULL"))
    with store.begin("1") as run:
        sg.add_segment(run, of("artifact_id IS NULL"))
    with store.begin("2") as run:
        sg.delete_chunks(run, of(gone).select(F.col("id").alias("chunk_id")))
    sg.merge_segments(store)
    with store.begin("3") as run:  # a session that went comes back, and one that stands is built anew
        again = of("session_id IN ('13', '4')")
        sg.delete_chunks(run, again.select(F.col("id").alias("chunk_id")))
        sg.add_segment(run, again)
    hits = se.search(sg.read_index(store.at()), t.chunks, t.sessions, t.sources, searches(t), 30)
    return hits.select("query_id", "chunk_id", "session_id", "rank", "position")


SAID = sql_strip("text")
PARTS = f"""SELECT conv_id, substring(said, s + 1, 8000) AS part
    FROM (SELECT conv_id, said, unnest(generate_series(0, (ceil(greatest(0, length(said) - 8000) / 7800.0) * 7800)::bigint, 7800)) AS s
          FROM (SELECT conv_id, {SAID} AS said FROM conversations) WHERE length(said) > 0)"""


#: Conversations of an export file, on average, and the files that a delivery is spread over at least.
FILE_CHATS, LEAST_FILES = 256, 8


def _export(t: Testbed, where: str, folder: str) -> None:
    """Export files of many whole conversations each, as chat services give them out; a file per conversation would cost more than its import."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    rows = t.table("conversations").filter(where)
    files = max(LEAST_FILES, -(-rows.select("conv_id").distinct().count() // FILE_CHATS))
    placed = rows.withColumn("file", F.pmod(F.xxhash64("conv_id"), F.lit(files))).repartition("file")
    chats = placed.groupBy("file", "conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    titled = chats.select("file", F.struct(F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), "messages").alias("chat"))
    exports = titled.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list("chat"))).alias("value")).select("value")
    staged = f"{folder}_{uuid.uuid4().hex}"
    exports.write.option("maxRecordsPerFile", 1).text(staged)
    _deliver(t.spark, staged, folder)


def _deliver(spark: SparkSession, staged: str, folder: str) -> None:
    """Move files into a folder that a stream watches, with the ending of their content; Spark's text files all end in .txt."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for file in fs.listStatus(path(staged)):
        name = file.getPath().getName()
        if name.startswith("part-") and not fs.rename(file.getPath(), path(f"{folder}/{name.removesuffix('.txt')}.json")):
            raise OSError(f"{name} could not be moved to {folder}")


@query(
    "stream_import",
    with_views(
        f"""SELECT title, n_messages, n_chunks, n_terms FROM
            (SELECT conv_id, 'Chat ' || conv_id AS title, count(*) FILTER (length({SAID}) > 0) AS n_messages FROM conversations GROUP BY conv_id)
            JOIN (SELECT conv_id, count(*) AS n_chunks, sum(len({sql_terms('part')}))::bigint AS n_terms FROM ({PARTS}) GROUP BY conv_id) USING (conv_id)"""
    ),
)
def stream_import(t: Testbed) -> DataFrame:
    """Files that arrive in three batches, one of which is delivered again and one of which first broke off."""
    store = new_store(t.spark, "stream")
    root = store.root
    inbox = f"{root}_inbox"
    for batch in range(3):
        _export(t, f"conv_id % 3 = {batch}", inbox)
        if batch == 1:  # a try that wrote a table and was lost
            store.begin("1").write("sessions", t.sessions)
        ingest_stream(t.spark, inbox, store, f"{root}_checkpoint", extraction=None).awaitTermination()
    ingest_batch(store, empty_table(t.spark, "sessions").select(F.col("id").alias("file_name"), F.col("id").alias("content")), 1, as_of())
    docs = sg.read_index(store).docs.groupBy("session_id").agg(F.sum("dl").alias("n_terms"), F.count("*").alias("n_chunks"))
    messages = store.read("messages").groupBy("session_id").agg(F.count("*").alias("n_messages"))
    named = store.read("sessions").select(F.col("id").alias("session_id"), "title")
    return named.join(messages, "session_id").join(docs, "session_id").drop("session_id")


@query(
    "maintenance_resumed",
    with_views(
        """SELECT * FROM (SELECT 'chunks' AS name, count(*) AS n_rows, 0 AS n_differ FROM v_chunks WHERE chunk_type = 'message'
           UNION ALL SELECT 'session_analytics', count(*), 0 FROM v_sessions
           UNION ALL SELECT 'import_batches', count(*), 0 FROM v_batches
           UNION ALL SELECT 'projects', count(*), 0 FROM v_sessions)"""
    ),
)
def maintenance_resumed(t: Testbed) -> DataFrame:
    """A maintenance run that stops after a stage and goes on, beside one that does not stop, over the same tables."""
    store = new_store(t.spark, "maintenance")
    with store.begin("0") as run:
        for name in ("sessions", "messages", "import_batches"):
            run.write(name, getattr(t, "batches" if name == "import_batches" else name))
        run.write("chunks", build_chunks(run.read("messages"), empty_table(t.spark, "artifacts")))
    resume_maintenance(store, "a", as_of(), stop_after="projects")
    store.write("messages", t.messages.limit(1), "1")  # what is imported meanwhile belongs to the next run
    resumed, ran = resume_maintenance(store, "a", as_of())
    assert ran == [s for s in STAGES[STAGES.index("projects") + 1:] if s != "candidates"]
    store.write("messages", empty_table(t.spark, "messages"), "1")
    whole, _ = resume_maintenance(store, "b", as_of())
    out = None
    for name in ("chunks", "session_analytics", "import_batches", "projects"):
        digest = lambda df: df.select(F.xxhash64(F.to_json(F.struct("*"))).alias("h"))
        both = digest(resumed[name]).withColumn("side", F.lit(1)).unionByName(digest(whole[name]).withColumn("side", F.lit(-1)))
        sums = both.groupBy("h").agg(F.sum("side").alias("d"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("n"))
        row = sums.agg(F.sum("n").alias("n_rows"), F.sum(F.abs("d")).alias("n_differ")).select(F.lit(name).alias("name"), "n_rows", "n_differ")
        out = row if out is None else out.unionByName(row)
    return out


@query("streamed_trend", "SELECT strftime(ts::date, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY ALL")
def streamed_trend(t: Testbed) -> DataFrame:
    """The events of each day, from three deliveries in the order of time and a last one that closes the days."""
    root = new_store(t.spark, "trend").root
    at = F.col("ts").cast("timestamp")
    ends = t.table("events").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    third = (ends["hi"] - ends["lo"]) / 3
    for i in range(3):
        lo, hi = ends["lo"] + i * third, ends["lo"] + (i + 1) * third
        due = (at >= F.lit(lo)) & ((at < F.lit(hi)) if i < 2 else F.lit(True))
        tr.write_arrivals(t.table("events").filter(due), at, f"{root}/in")
        tr.trend_stream(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    tr.close_days(t.spark, f"{root}/in", F.lit(ends["hi"]) + F.expr("INTERVAL 3 DAYS"))
    tr.trend_stream(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    return tr.closed_days(t.spark, f"{root}/out")
