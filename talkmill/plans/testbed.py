"""Canonical tables made from the driver's Parquet tables, so that every operator can run on them."""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.chunks import build_chunks
from talkmill.schema import conform
from talkmill.session import shared_folder
from talkmill.sources.store import TableStore

AS_OF = "2024-01-31 00:00:00"
AS_OF_REVISIT = "2024-02-15 00:00:00"


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def _s(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def new_store(spark: SparkSession, name: str) -> TableStore:
    """An empty store in the shared folder."""
    return TableStore(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def library(t: Testbed) -> TableStore:
    """The store that queries of one session over the same files share."""
    files = t.table("conversations").inputFiles() + t.table("documents").inputFiles()
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    known = []
    for file in sorted(files):
        status = path(file).getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path(file))
        known.append((file, status.getLen(), status.getModificationTime()))
    name = hashlib.sha256(repr(known).encode()).hexdigest()[:16]
    return TableStore(t.spark, f"{shared_folder(t.spark)}/library-{t.spark.sparkContext.applicationId}-{name}")


class Testbed:
    """Views over one scale-factor folder. Each view is built once and stays lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        seconds = (F.col("conv_id") % 30) * 86400 + F.col("turn") * 90
        return conform(
            self.table("conversations").select(
                F.concat_ws("-", _s("conv_id"), _s("turn")).alias("id"),
                _s("conv_id").alias("session_id"), "role",
                F.timestamp_seconds(F.unix_seconds(base) + seconds).alias("timestamp"),
                F.col("text").alias("content_text"), F.col("turn").alias("sort_order"),
            ),
            "messages",
        )

    @cached_property
    def all_messages(self) -> DataFrame:
        """The messages, and every document as a later user message of some session."""
        docs = self.table("documents").select(
            F.concat(F.lit("d"), _s("doc_id")).alias("id"), _s(F.col("doc_id") % 100).alias("session_id"),
            F.lit("user").alias("role"), F.col("text").alias("content_text"),
            (F.col("doc_id") + 1000).alias("sort_order"),
        )
        return self.messages.unionByName(conform(docs, "messages"))

    @cached_property
    def sessions(self) -> DataFrame:
        conv = F.col("conv_id")
        day = F.lit("2024-01-01 00:00:00").cast("timestamp")
        created = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-30 00:00:00").cast("timestamp")) + conv)
        return conform(
            self.table("conversations").select("conv_id").distinct().select(
                _s(conv).alias("id"),
                F.concat(F.lit("src"), _s(conv % 3)).alias("source_id"),
                F.concat(F.lit("batch"), _s(conv % 5)).alias("import_batch_id"),
                F.when(conv % 4 != 0, F.concat(F.lit("Topic "), _s(conv % 7))).alias("title"),
                F.when(conv % 11 != 0, F.timestamp_seconds(F.unix_seconds(day) + (conv % 30) * 86400)).alias("started_at"),
                F.lit("conversation").alias("session_type"),
                created.alias("created_at"), created.alias("updated_at"),
            ),
            "sessions",
        )

    @cached_property
    def event_sessions(self) -> DataFrame:
        """Every event as a session that began with it."""
        at = F.col("ts").cast("timestamp")
        return conform(
            self.table("events").select(
                _s("event_id").alias("id"), F.concat(F.lit("src"), _s(F.col("user_id") % 3)).alias("source_id"),
                F.col("event_type").alias("title"), at.alias("started_at"), at.alias("created_at"),
            ),
            "sessions",
        )

    @cached_property
    def sources(self) -> DataFrame:
        rows = [("src0", "chatgpt"), ("src1", "claude"), ("src2", "generic")]
        df = self.spark.createDataFrame(rows, "id string, type string")
        return conform(df.withColumn("adapter_key", F.concat("type", F.lit("-1.0.0"))), "sources")

    @cached_property
    def batches(self) -> DataFrame:
        """One import batch per group of sessions; some were indexed by an older version."""
        n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
        return conform(
            self.sessions.select(F.col("import_batch_id").alias("id")).distinct().select(
                "id", F.lit("src0").alias("source_id"), F.date_add(F.lit("2024-01-20").cast("date"), n).cast("timestamp").alias("imported_at"),
                F.concat("id", F.lit(".json")).alias("file_name"), F.sha2("id", 256).alias("file_hash"),
                F.when(n == 4, "failed").otherwise("completed").alias("status"),
                F.when(n <= 1, 0).otherwise(1).alias("search_index_version"),
            ),
            "import_batches",
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        doc = F.col("doc_id")
        session = _s(doc % 100)
        return conform(
            self.table("documents").select(
                F.concat(F.lit("a"), _s(doc)).alias("id"), session.alias("session_id"),
                F.when(doc % 2 == 1, F.concat(session, F.lit("-0"))).alias("message_id"),
                F.lit("markdown").alias("artifact_type"), F.col("source").alias("title"),
                F.col("text").alias("content_text"), F.lit("text/markdown").alias("mime_type"),
            ),
            "artifacts",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return build_chunks(self.messages, self.artifacts)

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        """The chunks, with a vector on those whose document has one."""
        vectors = self.table("embeddings").select(
            F.concat(F.lit("a"), _s("vec_id")).alias("artifact_id"), F.col("embedding").cast("array<double>").alias("embedding")
        )
        return self.chunks.drop("embedding").join(vectors, "artifact_id", "left")

    @cached_property
    def _links(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"),
            _s(F.col("user_id") + F.col("event_id") % 7).alias("session_id"),
            F.when(F.col("user_id") % 3 == 0, F.col("ts").cast("timestamp") - F.expr("INTERVAL 45 DAYS"))
            .otherwise(F.col("ts").cast("timestamp")).alias("project_ts"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Each event supports a theme, its type, and a project, its user's."""
        common = [
            "session_id", F.concat_ws("-", "session_id", _s(F.col("event_id") % 5)).alias("message_id"),
            F.concat(F.lit("event "), _s("event_id")).alias("excerpt"), F.lit(0.35).alias("evidence_score"),
        ]
        themes = self._links.select(
            F.concat(_s("event_id"), F.lit("-t")).alias("id"), F.lit("theme").alias("entity_type"),
            F.col("event_type").alias("entity_id"), *common, F.col("ts").alias("created_at"),
        )
        projects = self._links.select(
            F.concat(_s("event_id"), F.lit("-p")).alias("id"), F.lit("project").alias("entity_type"),
            F.concat(F.lit("p"), _s("user_id")).alias("entity_id"), *common, F.col("project_ts").alias("created_at"),
        )
        return conform(themes, "evidence_links").unionByName(conform(projects, "evidence_links"))

    @cached_property
    def themes(self) -> DataFrame:
        seen = self._links.groupBy("event_type").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
        return conform(
            seen.select(F.col("event_type").alias("id"), F.col("event_type").alias("label"), F.lit(0.35).alias("confidence"),
                        "first_seen_at", "last_seen_at"),
            "themes",
        )

    @cached_property
    def projects(self) -> DataFrame:
        seen = self._links.groupBy("user_id").agg(
            F.min("project_ts").alias("first_seen_at"), F.max("project_ts").alias("last_seen_at")
        )
        names = self.table("part").select(F.col("p_partkey").alias("user_id"), "p_name")
        user = F.col("user_id")
        return conform(
            seen.join(names, "user_id", "left").select(
                F.concat(F.lit("p"), _s(user)).alias("id"),
                F.coalesce("p_name", F.concat(F.lit("project "), _s(user))).alias("canonical_title"),
                F.when(user % 13 == 0, "archived").otherwise("speculative").alias("status"),
                F.lit(0.35).alias("confidence"),
                F.when(user % 5 != 0, (user % 10) / 10).alias("momentum_score"),
                "first_seen_at", "last_seen_at", F.lit(1).alias("source_span_count"),
            ),
            "projects",
        )

    @cached_property
    def merge_input(self) -> DataFrame:
        """Every part as a project; its shipments give the time span."""
        spans = self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
            F.min("l_shipdate").cast("timestamp").alias("first_seen_at"), F.max("l_shipdate").cast("timestamp").alias("last_seen_at")
        )
        key = F.col("p_partkey")
        return conform(
            self.table("part").join(spans, "p_partkey").select(
                F.concat(F.lit("p"), _s(key)).alias("id"), F.col("p_name").alias("canonical_title"),
                F.when(key % 5 != 0, F.col("p_type")).alias("description"),
                F.when(key % 13 == 0, "archived").otherwise("speculative").alias("status"),
                F.lit(0.35).alias("confidence"), "first_seen_at", "last_seen_at",
            ),
            "projects",
        )

    @cached_property
    def merge_requests(self) -> DataFrame:
        """Of projects with one title, the one with the smallest id absorbs all others."""
        # The smallest id per title is found by an aggregate; no window gathers a common title.
        least = self.projects.groupBy("canonical_title").agg(F.min("id").alias("surviving_project_id"))
        return (
            self.projects.join(least, "canonical_title")
            .filter(F.col("id") != F.col("surviving_project_id"))
            .select("surviving_project_id", F.col("id").alias("merged_project_id"), F.lit(1).alias("seq"))
        )
