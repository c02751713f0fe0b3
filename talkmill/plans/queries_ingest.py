"""Queries of the import formats. Export files are built from the conversations and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.plans.oracle_views import sql_strip, sql_time, with_views
from talkmill.plans.registry import query
from talkmill.plans.testbed import Testbed, as_of
from talkmill.schema import empty_table
from talkmill.sources import imports as im
from talkmill.sources.tree_export import extract_code_artifacts

FENCE = "```"


def _turns(t: Testbed) -> DataFrame:
    """One row per conversation with its ordered turns; the reply of turn 1 carries a code block."""
    code = F.concat(F.lit("\n" + FENCE + "python\n"), F.col("text"), F.lit("\n" + FENCE))
    text = F.when(F.col("turn") == 1, F.concat(F.col("text"), code)).otherwise(F.col("text"))
    turn = F.struct(F.col("turn"), F.col("role"), text.alias("text"))
    return t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def tree_files(t: Testbed, branching: bool = False) -> DataFrame:
    """A tree export per conversation: a root without a message, then each turn below the one before it.

    Every fifth conversation has a foreign role and must be rejected; every seventh has no title. Branching, turn i has the
    turns 2i + 2 and 2i + 1 below it, listed in that order.
    """
    node_id = F.concat(F.lit("n"), F.col("turn").cast("string"))

    def node(x: Column, i: Column) -> Column:
        role = F.when(F.col("conv_id") % 5 == 4, "narrator").otherwise(x.getField("role"))
        message = F.struct(
            F.concat(F.lit("m"), i.cast("string")).alias("id"), F.struct(role.alias("role")).alias("author"),
            (F.lit(1704067200) + F.col("conv_id") * 60 + i).alias("create_time"),
            F.struct(F.lit("text").alias("content_type"), F.array(x.getField("text")).alias("parts")).alias("content"),
        )
        name = lambda k: F.concat(F.lit("n"), k.cast("string"))
        below = F.array(i * 2 + 2, i * 2 + 1) if branching else F.array(i + 1)
        children = F.transform(F.filter(below, lambda k: k < F.size("turns")), name)
        above = F.floor((i - 1) / 2) if branching else i - 1
        return F.struct(
            F.concat(F.lit("n"), i.cast("string")).alias("key"),
            F.struct(
                F.concat(F.lit("n"), i.cast("string")).alias("id"), message.alias("message"),
                F.when(i == 0, F.lit("root")).otherwise(name(above)).alias("parent"), children.alias("children"),
            ).alias("node"),
        )

    nodes = F.map_from_entries(F.transform("turns", node))
    root = F.lit('"root":{"id":"root","message":null,"parent":null,"children":["n0"]}')
    body = F.to_json(nodes)
    mapping = F.concat(F.lit("{"), root, F.lit(","), F.substr(body, F.lit(2)))
    title = F.when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"title":"Chat '), F.col("conv_id").cast("string"), F.lit('",'))
    )
    content = F.concat(
        F.lit("[{"), title, F.lit('"conversation_id":"c'), F.col("conv_id").cast("string"), F.lit('","create_time":'),
        (F.lit(1704067200) + F.col("conv_id")).cast("string"), F.lit('.5,"mapping":'), mapping, F.lit("}]"),
    )
    name = F.concat(F.lit("/exports/"), F.col("conv_id").cast("string"), F.lit(".json"))
    return _turns(t).select(name.alias("file_name"), content.alias("content"))


def json_files(t: Testbed) -> DataFrame:
    """A plain JSON file per conversation: by turns a flat array, a wrapped object, and an array of two."""
    messages = F.to_json(
        F.transform("turns", lambda x: F.struct(
            x.getField("role").alias("role"), x.getField("text").alias("content"),
            F.concat(F.lit("2024-01-02T03:04:0"), x.getField("turn").cast("string"), F.lit("Z")).alias("timestamp"),
        ))
    )
    wrapped = F.concat(F.lit('{"title":"W'), F.col("conv_id").cast("string"), F.lit('","messages":'), messages, F.lit("}"))
    content = (
        F.when(F.col("conv_id") % 3 == 0, messages)
        .when(F.col("conv_id") % 3 == 1, wrapped)
        .otherwise(F.concat(F.lit("["), wrapped, F.lit(',{"messages":[]}]')))
    )
    name = F.concat(F.lit("/plain/"), F.col("conv_id").cast("string"), F.lit(".json"))
    return _turns(t).select(name.alias("file_name"), content.alias("content"))


def markdown_files(t: Testbed) -> DataFrame:
    """A transcript per conversation, with a preamble that belongs to no one."""
    part = F.transform(
        "turns", lambda x: F.concat(F.lit("## "), F.initcap(x.getField("role")), F.lit("\n\n"), x.getField("text"), F.lit("\n\n"))
    )
    content = F.concat(F.lit("# Notes\n\npreamble\n\n"), F.array_join(part, ""))
    name = F.concat(F.lit("/notes/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return _turns(t).select(name.alias("file_name"), content.alias("content"))


def _imported(t: Testbed, files: DataFrame) -> im.ImportRun:
    return im.import_files(files, empty_table(t.spark, "sources"), empty_table(t.spark, "import_batches"), as_of())


def _with_file(run: im.ImportRun, rows: DataFrame) -> DataFrame:
    """Name each row by its file, since ids are hashes."""
    batches = run.batches.select(F.col("id").alias("import_batch_id"), F.regexp_extract("file_name", "([0-9]+)", 1).alias("conv"))
    return rows.join(batches, "import_batch_id")


def _message_rows(run: im.ImportRun) -> DataFrame:
    sessions = run.sessions.select(
        F.col("id").alias("session_id"), "import_batch_id", F.coalesce("title", F.lit("-")).alias("title"), "external_id", "started_at"
    )
    rows = run.messages.select("session_id", "role", "sort_order", "timestamp", F.md5("content_text").alias("text_md5"))
    return _with_file(run, rows.join(sessions, "session_id")).drop("session_id", "import_batch_id")


CODED = f"text || CASE WHEN turn = 1 THEN chr(10) || '{FENCE}python' || chr(10) || text || chr(10) || '{FENCE}' ELSE '' END"


@query(
    "tree_export_messages",
    f"""SELECT conv_id::varchar AS conv, CASE WHEN conv_id % 7 = 0 THEN 'Untitled' ELSE 'Chat ' || conv_id END AS title,
           'c' || conv_id AS external_id, {sql_time("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id)")} AS started_at,
           role, turn + 0 AS sort_order, {sql_time("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn)")} AS timestamp,
           md5({sql_strip(CODED)}) AS text_md5
        FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)
        WHERE conv_id % 5 <> 4""",
)
def tree_export_messages(t: Testbed) -> DataFrame:
    return _message_rows(_imported(t, tree_files(t)))


@query(
    "branching_export_messages",
    f"""WITH RECURSIVE t AS (
          SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE conv_id % 5 <> 4),
        p AS (SELECT conv_id, i, '' AS path FROM t WHERE i = 0
              UNION ALL SELECT t.conv_id, t.i, path || CASE WHEN t.i % 2 = 0 THEN '0' ELSE '1' END
              FROM p JOIN t ON t.conv_id = p.conv_id AND (t.i - 1) // 2 = p.i AND t.i > 0)
        SELECT conv_id::varchar AS conv, role, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS sort_order,
               md5({sql_strip(CODED)}) AS text_md5
        FROM p JOIN t USING (conv_id, i)""",
)
def branching_export_messages(t: Testbed) -> DataFrame:
    """Reading order of trees with side branches."""
    return _message_rows(_imported(t, tree_files(t, branching=True))).select("conv", "role", "sort_order", "text_md5")


@query(
    "tree_export_artifacts",
    f"""SELECT conv_id::varchar AS conv, 'Code (python)' AS title, 'text/x-python' AS mime_type, md5({sql_strip('text')}) AS text_md5
        FROM conversations WHERE turn = 1 AND conv_id % 5 <> 4""",
)
def tree_export_artifacts(t: Testbed) -> DataFrame:
    run = _imported(t, tree_files(t))
    home = run.sessions.select(F.col("id").alias("session_id"), "import_batch_id")
    rows = _with_file(run, run.artifacts.join(home, "session_id"))
    return rows.select("conv", "title", "mime_type", F.md5("content_text").alias("text_md5"))


@query(
    "plain_json_messages",
    f"""SELECT conv_id::varchar AS conv, CASE WHEN conv_id % 3 = 0 THEN 'Import conversation 1' ELSE 'W' || conv_id END AS title,
           NULL AS external_id, {sql_time("TIMESTAMP '2024-01-02 03:04:00' + to_seconds(min(turn) OVER (PARTITION BY conv_id))")} AS started_at,
           role, turn AS sort_order, {sql_time("TIMESTAMP '2024-01-02 03:04:00' + to_seconds(turn)")} AS timestamp, md5({CODED}) AS text_md5
        FROM conversations""",
)
def plain_json_messages(t: Testbed) -> DataFrame:
    return _message_rows(_imported(t, json_files(t)))


@query(
    "transcript_messages",
    f"""SELECT conv_id::varchar AS conv, 'Import conversation 1' AS title, NULL AS external_id, NULL AS started_at, role,
           turn AS sort_order, NULL AS timestamp, md5({sql_strip(CODED)}) AS text_md5
        FROM conversations""",
)
def transcript_messages(t: Testbed) -> DataFrame:
    return _message_rows(_imported(t, markdown_files(t)))


@query(
    "import_warnings",
    """SELECT 'CHATGPT_CONVERSATION_PARSE_ERROR' AS code, conv_id::varchar AS conv, 1::bigint AS n
       FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 4
       UNION ALL
       SELECT 'GENERIC_EMPTY_CONVERSATION', conv_id::varchar, 1 FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 2""",
)
def import_warnings(t: Testbed) -> DataFrame:
    run = _imported(t, tree_files(t).unionByName(json_files(t)))
    return _with_file(run, im.warnings_by_batch(run.warnings)).select("code", "conv", "n")


@query(
    "import_batches",
    """SELECT conv_id::varchar AS conv, kind, CASE WHEN kind = 'chatgpt' AND conv_id % 5 = 4 THEN 0 ELSE 1 END::bigint AS session_count,
          CASE WHEN kind = 'chatgpt' AND conv_id % 5 = 4 THEN 1 WHEN kind = 'generic' AND conv_id % 3 = 2 THEN 1 ELSE 0 END::bigint AS warning_count,
          'completed' AS status
       FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['chatgpt', 'generic']) AS kind)""",
)
def import_batches(t: Testbed) -> DataFrame:
    run = _imported(t, tree_files(t).unionByName(json_files(t)))
    kinds = run.sources.select(F.col("id").alias("source_id"), F.col("type").alias("kind"))
    conv = F.regexp_extract("file_name", "([0-9]+)", 1).alias("conv")
    return run.batches.join(kinds, "source_id").select(conv, "kind", "session_count", "warning_count", "status")


@query(
    "duplicate_files",
    """WITH f AS (SELECT '/docs/' || lpad(doc_id::varchar, 9, '0') || '.md' AS name, '## User' || chr(10) || text AS body,
                         doc_id % 10 = 0 AS old FROM documents),
       known AS (SELECT DISTINCT sha256(body) AS h FROM f WHERE old),
       j AS (SELECT name, sha256(body) AS h, min(name) OVER (PARTITION BY sha256(body)) AS first FROM f)
       SELECT name AS file_name, CASE WHEN h IN (SELECT h FROM known) OR name <> first THEN 'duplicate' ELSE 'new' END AS verdict FROM j""",
)
def duplicate_files(t: Testbed) -> DataFrame:
    """Documents as transcripts: some were imported before, some are exact copies of each other."""
    name = F.concat(F.lit("/docs/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    files = t.table("documents").select(
        name.alias("file_name"), F.concat(F.lit("## User\n"), F.col("text")).alias("content"), "doc_id"
    ).withColumn("file_hash", F.sha2("content", 256))
    old = files.filter("doc_id % 10 = 0").select("file_hash", F.lit("completed").alias("status"))
    fresh, copies = im.dedupe_batches(files.drop("doc_id", "content"), old)
    return fresh.select("file_name", F.lit("new").alias("verdict")).unionByName(
        copies.select("file_name", F.lit("duplicate").alias("verdict"))
    )


@query(
    "code_artifacts",
    f"""SELECT conv_id || '-' || turn AS message_no, lang, n, md5({sql_strip('text')}) AS text_md5
        FROM conversations, (SELECT unnest(['Code (sql)', 'Code block']) AS lang, unnest([0, 1])::bigint AS n)""",
)
def code_artifacts(t: Testbed) -> DataFrame:
    """Every message wrapped twice in a fence, with and without a language."""
    text = F.concat(
        F.lit("x " + FENCE + "sql\n"), F.col("content_text"), F.lit("\n" + FENCE + "\n" + FENCE + "\n"), F.col("content_text"), F.lit(FENCE)
    )
    messages = t.messages.withColumn("content_text", text)
    found = extract_code_artifacts(messages.withColumn("session_id", F.col("id")))
    return found.select(
        F.col("session_id").alias("message_no"), F.col("title").alias("lang"),
        F.when(F.col("mime_type") == "text/x-sql", 0).otherwise(1).alias("n"), F.md5("content_text").alias("text_md5"),
    )


@query(
    "source_rows",
    with_views(
        """SELECT type, 'v' || (user_id % 3) AS adapter_key, bool_and(user_id % 3 = 0) AS known
           FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'chatgpt' ELSE 'generic' END AS type FROM v_links) GROUP BY ALL"""
    ),
)
def source_rows(t: Testbed) -> DataFrame:
    """Get-or-create of the sources that the events' users come from; one adapter is known before."""
    kind = F.when(F.col("user_id") % 2 == 0, "chatgpt").otherwise("generic").alias("type")
    seen = t.table("events").select(kind, F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("adapter_key"))
    known = seen.filter("adapter_key = 'v0'").distinct().withColumn("id", F.lit("old"))
    rows = im.upsert_sources(known, seen, as_of())
    return rows.select("type", "adapter_key", (F.col("id") == "old").alias("known"))
