"""Import runs: duplicate elimination, source dimension, batch summary and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.schema import SEARCH_INDEX_VERSION, conform, make_id
from talkmill.session import cut_lineage
from talkmill.sources.files import Adapter, Ingested, default_adapters, route_files


@dataclass(frozen=True)
class ImportRun:
    sources: DataFrame
    batches: DataFrame
    sessions: DataFrame
    messages: DataFrame
    artifacts: DataFrame
    warnings: DataFrame
    results: DataFrame


def dedupe_batches(files: DataFrame, existing_batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split routed files into those to import and duplicates.

    A duplicate has the hash of a completed batch, or of a file with a smaller name in the same run. Only
    (hash, name) pairs are grouped; the content joins back on both, so a hash shared by very many files never
    gathers their texts in one task.
    """
    done = existing_batches.filter("status = 'completed'").select("file_hash").distinct()
    fresh = files.select("file_hash", "file_name").join(done, "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("file_name").alias("file_name"))
    return (
        files.join(first, ["file_hash", "file_name"], "left_semi"),
        files.join(first, ["file_hash", "file_name"], "left_anti"),
    )


def upsert_sources(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Source rows with one more for each new (type, adapter_key)."""
    keys = ["type", "adapter_key"]
    new = incoming.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    rows = new.select(
        make_id("source", F.col("type"), F.col("adapter_key")).alias("id"),
        "type", F.col("type").alias("name"), "adapter_key",
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    return conform(existing, "sources").unionByName(conform(rows, "sources"))


def warnings_by_batch(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("import_batch_id", "code").agg(F.count("*").alias("n"))


def import_batch_summary(batches: DataFrame, sessions: DataFrame, warnings: DataFrame) -> DataFrame:
    """Batches with their session and warning counts, newest first."""
    n_sessions = sessions.groupBy("import_batch_id").agg(F.count("*").alias("session_count"))
    n_warnings = warnings.groupBy("import_batch_id").agg(F.count("*").alias("warning_count"))
    bare = batches.drop("session_count", "warning_count")
    return (
        bare.join(n_sessions.withColumnRenamed("import_batch_id", "id"), "id", "left")
        .join(n_warnings.withColumnRenamed("import_batch_id", "id"), "id", "left")
        .withColumn("session_count", F.coalesce("session_count", F.lit(0)))
        .withColumn("warning_count", F.coalesce("warning_count", F.lit(0)))
        .orderBy(F.desc("imported_at"), "id")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def import_files(
    files: DataFrame,
    existing_sources: DataFrame,
    existing_batches: DataFrame,
    as_of: Column,
    adapters: list[Adapter] | None = None,
) -> ImportRun:
    """Route, deduplicate and read files (file_name, content) into canonical rows.

    The routed files are stored once, since telling formats apart reads every file whole.
    """
    adapters = adapters or default_adapters()
    routed = cut_lineage(route_files(files, adapters))
    known = routed.filter(F.col("adapter_key").isNotNull())
    unknown = routed.filter(F.col("adapter_key").isNull())
    taken, duplicates = dedupe_batches(known, existing_batches)

    incoming = known.select(F.col("source_type").alias("type"), "adapter_key")
    sources = upsert_sources(existing_sources, incoming, as_of)
    ids = sources.groupBy("adapter_key", F.col("type").alias("source_type")).agg(F.min("id").alias("source_id"))
    taken = taken.join(ids, ["adapter_key", "source_type"]).withColumn(
        "import_batch_id", make_id("batch", F.col("file_hash"), F.col("file_name"))
    )
    # A file that is neither an array nor an object with messages cannot be read at all.
    broken = F.col("file_name").endswith(".json") & ~F.coalesce(
        F.from_json("content", "array<string>", {"allowSingleQuotes": "false"}).isNotNull()
        | F.array_contains(F.json_object_keys("content"), "messages"),
        F.lit(False),
    )
    taken = taken.withColumn("broken", broken)
    readable = taken.filter(~F.col("broken"))
    parts: list[Ingested] = [a.read(readable.filter(F.col("adapter_key") == a.key)) for a in adapters]
    sessions = _union([p.sessions for p in parts])
    sessions = sessions.withColumn("created_at", as_of).withColumn("updated_at", as_of)
    warnings = _union([p.warnings for p in parts])

    batches = readable.select(
        F.col("import_batch_id").alias("id"), "source_id", as_of.alias("imported_at"), "file_name", "file_hash",
        F.substring_index("adapter_key", "-", -1).alias("parser_version"),
        F.lit("completed").alias("status"),
        F.lit(SEARCH_INDEX_VERSION).alias("search_index_version"),
    )
    batches = import_batch_summary(batches, sessions, warnings)
    duplicate_warnings = duplicates.select(
        F.lit("").alias("import_batch_id"), F.lit("DUPLICATE_IMPORT").alias("code"),
        F.concat(
            F.lit('File "'), F.col("file_name"), F.lit('" has already been imported (matching content hash).')
        ).alias("message"),
    )
    results = (
        batches.select("file_name", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
        .unionByName(
            duplicates.select("file_name", F.lit("completed").alias("status"), F.lit("duplicate").alias("error"))
        )
        .unionByName(
            taken.filter("broken").select(
                "file_name", F.lit("failed").alias("status"), F.lit("Unsupported JSON format").alias("error")
            )
        )
        .unionByName(
            unknown.select(
                "file_name", F.lit("failed").alias("status"),
                F.concat(F.lit("No adapter could parse file: "), F.col("file_name")).alias("error"),
            )
        )
    )
    return ImportRun(
        sources=sources,
        batches=conform(batches, "import_batches"),
        sessions=conform(sessions, "sessions"),
        messages=_union([p.messages for p in parts]),
        artifacts=_union([p.artifacts for p in parts]),
        warnings=warnings.unionByName(conform(duplicate_warnings, "parse_warnings")),
        results=results,
    )
