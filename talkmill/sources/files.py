"""Whole-file reading, format routing and the adapter registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.text import WS, fingerprint

BOM = chr(0xFEFF)

# How much of a file the format checks look at, in bytes.
JSON_SNIFF_BYTES = 2000
MARKDOWN_SNIFF_BYTES = 5000


@dataclass(frozen=True)
class Ingested:
    """What a reader makes of its files."""

    sessions: DataFrame
    messages: DataFrame
    artifacts: DataFrame
    warnings: DataFrame


@dataclass(frozen=True)
class Adapter:
    """A chat format: a test on (file_name, content) and a reader of the files that pass it.

    ``read`` gets columns import_batch_id, source_id, file_hash, file_name and content.
    """

    source_type: str
    version: str
    accepts: Callable[[Column, Column], Column]
    read: Callable[[DataFrame], Ingested]

    @property
    def key(self) -> str:
        return f"{self.source_type}-{self.version}"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: file_name, content. An export is one JSON value, so a file is never split."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("file_name"),
        F.regexp_replace("value", f"^{BOM}", "").alias("content"),
    )


def _head(content: Column, size: int) -> Column:
    return F.substring(F.encode(content, "UTF-8"), 1, size).cast("string")


def json_items(content: Column) -> Column:
    """The elements of a JSON array as JSON texts; null when the text is no JSON array.

    Elements stay text because a VARIANT value has a size limit that whole exports exceed.
    """
    options = {"allowSingleQuotes": "false"}
    is_array = content.rlike(f"^[{WS}]*\\[") & content.rlike(f"\\][{WS}]*$")
    return F.when(is_array, F.from_json(content, "array<string>", options))


def looks_like_tree_export(file_name: Column, content: Column) -> Column:
    first = F.get(json_items(content), F.lit(0))
    has_mapping = F.array_contains(F.json_object_keys(first), "mapping")
    return file_name.endswith(".json") & F.coalesce(has_mapping, F.lit(False))


def looks_like_generic(file_name: Column, content: Column) -> Column:
    json_like = file_name.endswith(".json") & _head(content, JSON_SNIFF_BYTES).rlike(f"^[{WS}]*[\\[{{]")
    markdown = is_markdown_name(file_name) & _head(content, MARKDOWN_SNIFF_BYTES).rlike(
        f"(?im)^##[{WS}]+(User|Assistant)"
    )
    return json_like | markdown


def is_markdown_name(file_name: Column) -> Column:
    return file_name.endswith(".md") | file_name.endswith(".markdown") | file_name.endswith(".txt")


def route_files(files: DataFrame, adapters: list[Adapter] | None = None) -> DataFrame:
    """Add adapter_key and source_type: the first adapter that accepts the file, or null."""
    adapters = adapters or default_adapters()
    key = source = F.lit(None).cast("string")
    for adapter in reversed(adapters):
        accepted = adapter.accepts(F.col("file_name"), F.col("content"))
        key = F.when(accepted, F.lit(adapter.key)).otherwise(key)
    routed = files.withColumn("adapter_key", key)
    for adapter in adapters:
        source = F.when(F.col("adapter_key") == adapter.key, F.lit(adapter.source_type)).otherwise(source)
    return routed.withColumn("source_type", source).withColumn("file_hash", fingerprint(F.col("content")))


def default_adapters() -> list[Adapter]:
    from talkmill.sources.generic import read_generic
    from talkmill.sources.tree_export import read_tree_export

    return [
        Adapter("chatgpt", "1.0.0", looks_like_tree_export, read_tree_export),
        Adapter("generic", "1.0.0", looks_like_generic, read_generic),
    ]
