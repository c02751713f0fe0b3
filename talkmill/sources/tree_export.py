"""Tree-shaped chat exports: an array of conversations, each a map of linked nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from talkmill.functions.rows import each
from talkmill.functions.text import fingerprint, strip_ws
from talkmill.schema import conform, make_id
from talkmill.session import cut_lineage
from talkmill.sources.files import Ingested, json_items

# Leaves are VARIANT, so that a value of a wrong type is seen as such instead of being converted.
MESSAGE_TYPE = (
    "struct<id: variant, author: struct<role: variant, name: variant, metadata: variant>, "
    "create_time: variant, update_time: variant, "
    "content: struct<content_type: variant, parts: array<variant>>, status: variant, metadata: variant>"
)
CONVERSATION_TYPE = (
    "title variant, create_time variant, update_time variant, conversation_id variant, id variant, "
    f"mapping map<string, struct<id: variant, message: {MESSAGE_TYPE}, parent: variant, "
    "children: array<variant>>>, _corrupt string"
)

# Roles, code fence and artifact formats of the export.
EXPORT_ROLES = ["user", "assistant", "system", "tool"]
CODE_FENCE = r"```(\w*)\n([\s\S]*?)```"
DEFAULT_TITLE = "Untitled"


def _kind(value: Column) -> Column:
    """JSON type of a leaf; MISSING for an absent one."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "MISSING")
        .when(name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "NUMBER")
        .when(name.startswith("OBJECT"), "OBJECT")
        .otherwise(name)
    )


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return F.when(_kind(value) == "NUMBER", F.try_variant_get(value, "$", "double"))


def _seconds_to_time(seconds: Column) -> Column:
    """Unix seconds to a timestamp; zero counts as absent."""
    return F.timestamp_millis(F.floor(F.nullif(seconds, F.lit(0.0)) * 1000).cast("bigint"))


def _message_ok(m: Column) -> Column:
    author, content = m.getField("author"), m.getField("content")
    content_ok = content.isNull() | (_kind(content.getField("content_type")) == "STRING")
    return (
        (_kind(m.getField("id")) == "STRING")
        & F.coalesce(_text(author.getField("role")).isin(EXPORT_ROLES), F.lit(False))
        & _kind(author.getField("name")).isin("STRING", "VOID", "MISSING")
        & _kind(author.getField("metadata")).isin("OBJECT", "MISSING")
        & _kind(m.getField("create_time")).isin("NUMBER", "VOID", "MISSING")
        & _kind(m.getField("update_time")).isin("NUMBER", "VOID", "MISSING")
        & _kind(m.getField("status")).isin("STRING", "MISSING")
        & _kind(m.getField("metadata")).isin("OBJECT", "MISSING")
        & content_ok
    )


def _node_ok(node: Column) -> Column:
    children = F.coalesce(node.getField("children"), F.array().cast("array<variant>"))
    return F.coalesce(
        (_kind(node.getField("id")) == "STRING")
        & _kind(node.getField("parent")).isin("STRING", "VOID", "MISSING")
        & F.forall(children, lambda c: _kind(c) == "STRING")
        & (node.getField("message").isNull() | _message_ok(node.getField("message"))),
        F.lit(False),
    )


def parse_conversations(files: DataFrame) -> DataFrame:
    """One row per conversation: file columns, index, its JSON text, parsed columns and ``valid``."""
    items = each(files, json_items(F.col("content")), "index", "raw", "import_batch_id", "source_id", "file_hash")
    options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    parsed = items.withColumn("conv", F.from_json("raw", CONVERSATION_TYPE, options))
    valid = (
        F.col("conv._corrupt").isNull()
        & F.col("conv.mapping").isNotNull()
        & _kind(F.col("conv.title")).isin("STRING", "MISSING")
        & _kind(F.col("conv.create_time")).isin("NUMBER", "VOID", "MISSING")
        & _kind(F.col("conv.update_time")).isin("NUMBER", "VOID", "MISSING")
        & _kind(F.col("conv.conversation_id")).isin("STRING", "MISSING")
        & _kind(F.col("conv.id")).isin("STRING", "MISSING")
        & F.forall(F.map_values("conv.mapping"), _node_ok)
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


@F.pandas_udf(ArrayType(IntegerType()))
def tree_order(keys: pd.Series, ids: pd.Series, parents: pd.Series, children: pd.Series) -> pd.Series:
    """Positions of a conversation's nodes in reading order; null when it has no root.

    A depth-first walk that takes each node once. Shared children and cycles rule out a recursive query, and
    one conversation is one row, so this is a small helper on a narrow column.
    """

    def one(node_keys, node_ids, node_parents, node_children):
        if node_keys is None:
            return None
        place = {k: i for i, k in enumerate(node_keys)}

        def rank(i: int):
            k = node_keys[i]
            numeric = k.isdigit() and k.isascii() and str(int(k)) == k and int(k) < 2**32 - 1
            return (0, int(k)) if numeric else (1, i)

        listed = sorted(range(len(node_keys)), key=rank)
        roots = [node_ids[i] for i in listed if not node_parents[i] or node_parents[i] not in place]
        if not roots:
            return None
        order, seen = [], set()
        stack = roots[::-1]
        while stack:
            node = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            at = place.get(node)
            if at is not None:
                order.append(at)
                stack.extend(reversed(node_children[at]))
        return order

    return pd.Series([one(*row) for row in zip(keys, ids, parents, children)], dtype="object")


def linearize_tree(conversations: DataFrame) -> DataFrame:
    """Add ``ordered``: the messages that have content, in reading order. Null when no root exists."""
    nodes = F.map_values("conv.mapping")
    order = tree_order(
        F.map_keys("conv.mapping"),
        F.transform(nodes, lambda n: _text(n.getField("id"))),
        F.transform(nodes, lambda n: F.coalesce(_text(n.getField("parent")), F.lit(""))),
        F.transform(
            nodes,
            lambda n: F.transform(
                F.coalesce(n.getField("children"), F.array().cast("array<variant>")), lambda c: _text(c)
            ),
        ),
    )
    with_nodes = conversations.withColumn("order", order).withColumn("nodes", F.map_values("conv.mapping"))
    messages = F.transform("order", lambda i: F.get(F.col("nodes"), i).getField("message"))
    has_content = F.filter(messages, lambda m: m.getField("content").isNotNull())
    return with_nodes.withColumn("ordered", has_content).drop("order", "nodes")


def message_text(content: Column) -> Column:
    """String parts joined by newlines, trimmed."""
    parts = F.filter(content.getField("parts"), lambda p: _kind(p) == "STRING")
    joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$", "string")), "\n")
    return F.coalesce(strip_ws(joined), F.lit(""))


def extract_code_artifacts(messages: DataFrame) -> DataFrame:
    """Fenced code blocks of each message as artifact rows."""
    blocks = F.arrays_zip(
        F.regexp_extract_all("content_text", F.lit(CODE_FENCE), F.lit(1)).alias("lang"),
        F.regexp_extract_all("content_text", F.lit(CODE_FENCE), F.lit(2)).alias("body"),
    )
    fenced = messages.filter(F.contains("content_text", F.lit("```")))
    rows = each(fenced, blocks, "block_no", "block", "id", "session_id")
    lang = F.nullif(F.col("block.lang"), F.lit(""))
    return rows.select(
        make_id("artifact", F.col("id"), F.col("block_no")).alias("id"),
        "session_id",
        F.lit(None).cast("string").alias("message_id"),
        F.lit("code").alias("artifact_type"),
        F.coalesce(F.concat(F.lit("Code ("), lang, F.lit(")")), F.lit("Code block")).alias("title"),
        strip_ws(F.col("block.body")).alias("content_text"),
        F.coalesce(F.concat(F.lit("text/x-"), lang), F.lit("text/plain")).alias("mime_type"),
    )


def warning_rows(conversations: DataFrame, *checks: tuple[Column, str, Column]) -> DataFrame:
    """parse_warnings rows: a conversation gives one for each (condition, code, message) that holds."""
    found = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message")))
        for condition, code, message in checks
    ]))
    context = F.create_map(F.lit("index"), F.col("index").cast("string")).alias("context")
    rows = each(conversations, found, "n", "w", "import_batch_id", context)
    return conform(rows.select("import_batch_id", "w.code", "w.message", "context"), "parse_warnings")


def read_tree_export(files: DataFrame) -> Ingested:
    """Parse once, store the conversations, and take every table from them."""
    parsed = linearize_tree(parse_conversations(files))
    convs = cut_lineage(parsed.select(
        "import_batch_id", "source_id", "index", "valid", "ordered",
        make_id("session", F.col("file_hash"), F.col("index")).alias("session_id"),
        F.coalesce(_text(F.col("conv.conversation_id")), _text(F.col("conv.id"))).alias("external_id"),
        F.coalesce(_text(F.col("conv.title")), F.lit(DEFAULT_TITLE)).alias("title"),
        _seconds_to_time(_number(F.col("conv.create_time"))).alias("started_at"),
        _seconds_to_time(_number(F.col("conv.update_time"))).alias("ended_at"),
    ))
    full = convs.filter(F.col("valid") & (F.size("ordered") > 0))
    sessions = full.select(
        F.col("session_id").alias("id"), "source_id", "import_batch_id", "external_id",
        F.nullif("title", F.lit("")).alias("title"), "started_at", "ended_at",
        F.lit("conversation").alias("session_type"),
    )
    said = (
        each(full, F.col("ordered"), "sort_order", "m", "session_id")
        .withColumn("content_text", message_text(F.col("m.content")))
        .filter(F.col("content_text") != "")
    )
    messages = said.select(
        make_id("message", F.col("session_id"), F.col("sort_order")).alias("id"),
        "session_id",
        _text(F.col("m.author.role")).alias("role"),
        _text(F.col("m.author.name")).alias("author_label"),
        _seconds_to_time(_number(F.col("m.create_time"))).alias("timestamp"),
        "content_text",
        fingerprint(F.col("content_text")).alias("content_hash"),
        F.to_json("m").alias("raw_payload"),
        "sort_order",
    )
    at_index = F.concat(F.lit(" at index "), F.col("index").cast("string"))
    none_ordered = F.coalesce(F.size("ordered"), F.lit(0)) <= 0
    warnings = warning_rows(
        convs,
        (~F.col("valid"), "CHATGPT_CONVERSATION_PARSE_ERROR", F.concat(F.lit("Failed to parse conversation"), at_index)),
        (
            F.col("valid") & F.col("ordered").isNull(), "CHATGPT_NO_ROOT_NODE",
            F.concat(F.lit("No root node found in conversation"), at_index),
        ),
        (
            F.col("valid") & none_ordered, "CHATGPT_EMPTY_CONVERSATION",
            F.concat(F.lit('Conversation "'), F.col("title"), F.lit('"'), at_index, F.lit(" has no messages")),
        ),
    )
    return Ingested(
        conform(sessions, "sessions"), conform(messages, "messages"),
        conform(extract_code_artifacts(messages), "artifacts"), warnings,
    )
