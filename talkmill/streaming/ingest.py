"""New export files, as they arrive, into the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkmill.functions.embedding import EmbeddingProvider
from talkmill.operators.chunks import build_chunks
from talkmill.operators.embeddings import with_embeddings
from talkmill.operators.extraction import ExtractionProvider, extract_projects
from talkmill.operators.segments import add_segment
from talkmill.sources.files import BOM, Adapter
from talkmill.sources.imports import import_files
from talkmill.sources.store import TableStore


def ingest_batch(
    store: TableStore,
    files: DataFrame,
    run: int,
    as_of,
    adapters: list[Adapter] | None = None,
    embedding: EmbeddingProvider | None = None,
    extraction: ExtractionProvider | None = extract_projects,
) -> None:
    """Import one batch of files (file_name, content) as run ``run`` of the store.

    Tables and index segment of a run become visible together, and only earlier runs are looked at. A batch that Spark delivers
    again finds its run committed and does nothing; one whose first try broke off is staged anew.
    """
    if store.committed(str(run)):
        return
    with store.begin(str(run)) as staged:
        old_sources = store.read("sources", before=run)
        got = import_files(files, old_sources, store.read("import_batches", before=run), as_of, adapters)
        staged.write("sources", got.sources.join(old_sources.select("id"), "id", "left_anti"))
        for name, df in (
            ("sessions", got.sessions), ("messages", got.messages), ("artifacts", got.artifacts),
            ("parse_warnings", got.warnings), ("import_batches", got.batches),
        ):
            staged.write(name, df)
        sessions, messages, artifacts = (staged.read(n) for n in ("sessions", "messages", "artifacts"))
        staged.write("chunks", with_embeddings(build_chunks(messages, artifacts), embedding))
        add_segment(staged, staged.read("chunks"))
        if extraction is not None:
            found = extraction(sessions, messages, artifacts, as_of)
            staged.write("projects", found.projects)
            staged.write("evidence_links", found.evidence)


def ingest_stream(
    spark: SparkSession,
    folder: str,
    store: TableStore,
    checkpoint: str,
    on_batch: Callable[[TableStore, DataFrame, int, object], None] | None = None,
    **options,
) -> StreamingQuery:
    """Start the incremental import of a folder; it takes the files that are there and ends."""
    raw = spark.readStream.format("text").option("wholetext", "true").load(folder)
    files = raw.select(
        F.col("_metadata.file_path").alias("file_name"),
        F.regexp_replace("value", f"^{BOM}", "").alias("content"),
        F.current_timestamp().alias("seen_at"),
    )

    def one(batch: DataFrame, batch_id: int) -> None:
        # The stream's own time of the batch is kept with its offsets, so a batch that is delivered again has the same one.
        seen = batch.select("seen_at").first()
        if seen is None:
            return
        as_of = F.lit(seen[0])
        if on_batch is not None:
            on_batch(store, batch, batch_id, as_of)
        else:
            ingest_batch(store, batch.select("file_name", "content"), batch_id, as_of, **options)

    return (
        files.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(one)
        .start()
    )
