"""The text index as immutable segments in a table store.

A run adds a segment: a row per chunk with its terms in a column per term bucket, and its totals. Chunks that go are named in a
deletion set of the run that drops them, which holds for all segments of earlier runs; the segments themselves stay as they were
written. A search reads its own buckets of all segments less what is deleted, and takes the corpus's totals from those of the segments, so it
finds what an index built anew would. ``merge_segments`` writes many small segments, without what is deleted, as one.

Segment and deletions are parts of the run that also writes the chunks, so readers see both or neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators.search import TextIndex, build_text_index, by_bucket
from talkmill.sources.store import RUN, Run, TableStore

DOCS, DELETED, TOTALS = "index_docs", "index_deleted", "index_totals"
#: Term buckets of a segment; all segments of a store have the same.
BUCKETS = 64
#: Deleted chunk ids of up to so many bytes are sent to all tasks; more are joined by a shuffle of the rows that are read.
GONE_BYTES = 64 << 20


def _totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy(RUN).agg(F.count("*").alias("n_docs"), F.sum("dl").cast("bigint").alias("n_terms"))


def add_segment(run: Run, chunks: DataFrame) -> None:
    """Stage the index of a run's chunks. Chunk ids that an earlier run indexed and that still stand must be deleted first or in this run."""
    run.write(DOCS, by_bucket(build_text_index(chunks).lists, BUCKETS))
    run.write(TOTALS, _totals(run.read(DOCS).withColumn(RUN, F.lit(run.run))).drop(RUN))


def delete_chunks(run: Run, gone: DataFrame) -> None:
    """Stage the deletion of chunks (chunk_id) from all earlier segments. Ids that are not there, or not any more, change nothing."""
    standing = _standing(run.store, int(run.run)).select("chunk_id", "dl")
    run.write(DELETED, standing.join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi"))


def _standing(store: TableStore, before: int | None = None) -> DataFrame:
    """The rows of the segments, with RUN, whose chunk no later run deleted."""
    rows = store.read(DOCS, before=before, with_run=True)
    if not store.has(DELETED):
        return rows
    gone = store.read(DELETED, before=before, with_run=True).groupBy("chunk_id").agg(F.max(F.col(RUN).cast("bigint")).alias("_gone"))
    if (gone.agg(F.sum(F.octet_length("chunk_id").cast("bigint"))).first()[0] or 0) <= GONE_BYTES:
        gone = F.broadcast(gone)
    later = (rows["chunk_id"] == gone["chunk_id"]) & (rows[RUN].cast("bigint") < gone["_gone"])
    return rows.join(gone, later, "left_anti")


def read_index(store: TableStore) -> TextIndex:
    """The index of what stands, at the store's version."""
    totals = store.read(TOTALS).agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t"))
    if store.has(DELETED):
        gone = store.read(DELETED).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"))
        totals = totals.unionByName(gone.select((-F.col("n")).alias("n"), (-F.col("t")).alias("t"))).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    corpus = totals.select("n", (F.col("t").cast("double") / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))
    return TextIndex(_standing(store).drop(RUN), BUCKETS, corpus)


def merge_segments(store: TableStore) -> int:
    """Write all segments as one, without what is deleted; the new version. A segment added meanwhile stays beside it."""
    base = store.state()
    pinned = store.at(base["version"])
    docs = _standing(pinned)
    return store.replace({DOCS: docs, TOTALS: _totals(docs), DELETED: None}, base)
