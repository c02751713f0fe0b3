"""Plain JSON conversations and markdown transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.rows import each
from talkmill.functions.text import WS, fingerprint, strip_ws
from talkmill.schema import conform, make_id
from talkmill.session import cut_lineage
from talkmill.sources.files import Ingested, is_markdown_name, json_items
from talkmill.sources.tree_export import EXPORT_ROLES, _kind, _text, warning_rows

# A transcript's header line.
HEADER_ROLES = "User|Assistant|System|Tool"
_LINE_WS = WS.replace("\n", "")
HEADER_LINE = f"(?i)(?:^|(?<=\\n))##[{_LINE_WS}]+({HEADER_ROLES})[{_LINE_WS}]*(?=\\n|$)"

_MESSAGE_TYPE = "role variant, content variant, timestamp variant, _corrupt string"
_WRAPPED_TYPE = "title variant, messages array<string>, _corrupt string"
_OPTIONS = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
_MESSAGES = "array<struct<role: string, content: string, timestamp: string, raw: string>>"


def json_conversations(files: DataFrame) -> DataFrame:
    """Conversations of a flat message array, an array of wrapped conversations, or one wrapped object."""
    items = json_items(F.col("content"))
    keys = F.json_object_keys(F.get(F.col("items"), F.lit(0)))
    flat = F.coalesce(F.array_contains(keys, "content") & ~F.array_contains(keys, "messages"), F.lit(False))
    single = F.array_contains(F.json_object_keys("content"), "messages")
    shaped = files.withColumn("items", items).withColumn("flat", flat)
    no_text, no_items = F.lit(None).cast("string").alias("raw"), F.lit(None).cast("array<string>").alias("items")
    layouts = (
        F.when(F.col("flat"), F.array(F.struct(no_text, F.col("items"))))
        .when(F.col("items").isNotNull(), F.transform("items", lambda i: F.struct(i.alias("raw"), no_items)))
        .when(single, F.array(F.struct(F.col("content").alias("raw"), no_items)))
    )
    mode = F.when(F.col("flat"), "json_array").otherwise("json_wrapped").alias("mode")
    convs = each(shaped, layouts, "index", "conv", "import_batch_id", "source_id", "file_hash", mode)
    wrapped = F.from_json(F.col("conv.raw"), _WRAPPED_TYPE, _OPTIONS)
    parsed = convs.withColumn("w", wrapped).withColumn("texts", F.coalesce("conv.items", "w.messages"))
    messages = F.transform("texts", lambda t: F.from_json(t, _MESSAGE_TYPE, _OPTIONS))
    parsed = parsed.withColumn("parsed", messages)
    message_ok = F.forall(
        "parsed",
        lambda m: F.coalesce(
            m.getField("_corrupt").isNull()
            & ((_kind(m.getField("role")) == "MISSING") | _text(m.getField("role")).isin(EXPORT_ROLES))
            & (_kind(m.getField("content")) == "STRING")
            & _kind(m.getField("timestamp")).isin("STRING", "VOID", "MISSING"),
            F.lit(False),
        ),
    )
    valid = (
        F.col("texts").isNotNull()
        & F.col("w._corrupt").isNull()
        & _kind(F.col("w.title")).isin("STRING", "VOID", "MISSING")
        & message_ok
    )
    rows = F.transform(
        F.arrays_zip(F.col("parsed").alias("m"), F.col("texts").alias("raw")),
        lambda z: F.struct(
            F.coalesce(_text(z.getField("m").getField("role")), F.lit("user")).alias("role"),
            _text(z.getField("m").getField("content")).alias("content"),
            _text(z.getField("m").getField("timestamp")).alias("timestamp"),
            z.getField("raw").alias("raw"),
        ),
    )
    return parsed.select(
        "import_batch_id", "source_id", "file_hash", "mode", "index",
        _text(F.col("w.title")).alias("title"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
        rows.cast(_MESSAGES).alias("messages"),
    )


def markdown_messages(content: Column) -> Column:
    """Sections of a transcript. Text before the first header is dropped; so is a header with no line below."""
    roles = F.regexp_extract_all(content, F.lit(HEADER_LINE), F.lit(1))
    bodies = F.split(content, HEADER_LINE)
    bodies = F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0)))
    sections = F.transform(
        F.arrays_zip(roles.alias("role"), bodies.alias("body")),
        lambda s, i: F.struct(s.getField("role").alias("role"), s.getField("body").alias("body"), i.alias("i")),
    )
    last = F.size(roles) - 1
    kept = F.filter(
        sections,
        lambda s: F.when(s.getField("i") == last, s.getField("body") != "").otherwise(s.getField("body") != "\n"),
    )
    return F.transform(
        kept,
        lambda s: F.struct(
            F.lower(s.getField("role")).alias("role"),
            strip_ws(s.getField("body")).alias("content"),
            F.lit(None).cast("string").alias("timestamp"),
            F.lit(None).cast("string").alias("raw"),
        ),
    )


def markdown_conversations(files: DataFrame) -> DataFrame:
    return files.select(
        "import_batch_id", "source_id", "file_hash",
        F.lit("markdown").alias("mode"),
        F.lit(0).alias("index"),
        F.lit(None).cast("string").alias("title"),
        F.lit(True).alias("valid"),
        markdown_messages(F.col("content")).cast(_MESSAGES).alias("messages"),
    )


def read_generic(files: DataFrame) -> Ingested:
    """Parse once, store the conversations, and take every table from them."""
    markdown = is_markdown_name(F.col("file_name"))
    convs = json_conversations(files.filter(~markdown)).unionByName(markdown_conversations(files.filter(markdown)))
    convs = cut_lineage(convs)
    full = convs.filter(F.col("valid") & (F.size("messages") > 0)).withColumn(
        "session_id", make_id("session", F.col("file_hash"), F.col("index"))
    )
    default_title = F.concat(F.lit("Import conversation "), (F.col("index") + 1).cast("string"))
    sessions = full.select(
        F.col("session_id").alias("id"), "source_id", "import_batch_id",
        F.coalesce("title", default_title).alias("title"),
        F.try_to_timestamp(F.element_at("messages", 1).getField("timestamp")).alias("started_at"),
        F.try_to_timestamp(F.element_at("messages", -1).getField("timestamp")).alias("ended_at"),
        F.lit("conversation").alias("session_type"),
        F.create_map(F.lit("mode"), F.col("mode")).alias("metadata"),
    )
    said = each(full, F.col("messages"), "sort_order", "m", "session_id")
    messages = said.select(
        make_id("message", F.col("session_id"), F.col("sort_order")).alias("id"),
        "session_id",
        F.col("m.role").alias("role"),
        F.try_to_timestamp("m.timestamp").alias("timestamp"),
        F.col("m.content").alias("content_text"),
        fingerprint(F.col("m.content")).alias("content_hash"),
        F.coalesce(
            F.col("m.raw"), F.to_json(F.struct(F.col("m.role").alias("role"), F.col("m.content").alias("content")))
        ).alias("raw_payload"),
        "sort_order",
    )
    at_index = F.concat(F.lit(" at index "), F.col("index").cast("string"))
    empty = F.col("valid") & (F.size("messages") <= 0)
    warnings = warning_rows(
        convs,
        (~F.col("valid"), "GENERIC_CONVERSATION_PARSE_ERROR", F.concat(F.lit("Failed to parse conversation"), at_index)),
        (
            empty & (F.col("mode") == "markdown"), "GENERIC_MARKDOWN_NO_MESSAGES",
            F.lit("No ## User/## Assistant sections found in markdown file"),
        ),
        (empty, "GENERIC_EMPTY_CONVERSATION", F.concat(F.lit("Conversation"), at_index, F.lit(" has no messages"))),
    )
    artifacts = conform(full.select(F.lit(None).cast("string").alias("id")).filter(F.lit(False)), "artifacts")
    return Ingested(conform(sessions, "sessions"), conform(messages, "messages"), artifacts, warnings)
