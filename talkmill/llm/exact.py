"""Exact deduplication by a stateful stream.

Arrivals, one small row per document with digest, id and content locator, run through a structured stream. Its state, one
entry per digest in RocksDB on the executors' disks, never expires and keeps the row that stays, its locator and the group's
size; no text enters the stream or the state. Arrivals are combined per task before the shuffle, so a digest with a third of
all rows costs each task one row. A digest that was met before is only a hit: the full text of every hit is compared with the
text at the state's locator, and should two texts share a digest, their groups are formed by the texts themselves.

Null counts as empty, and all empty texts are equal. Of equal texts the row with the largest key stays; a null key is the
smallest. Rows equal in key and text are told apart by their locator, and one of them stays. An empty table gives no rows.
Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.common import keep_possible, located, new_folder, packed, settled, stored, text_or_empty, without

#: Arrivals that a micro-batch takes at most; one takes about 60 bytes.
BYTES_PER_TRIGGER = 1 << 30
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A store is closed after its commit: each open one holds several MB of disk and memory, whatever its size.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def run_stream(spark: SparkSession, arrivals: str, schema, state: str, updates: str, options: dict[str, str]) -> None:
    """Bring the state up to all arrivals written so far. Called again with the same folders, it takes only the new ones."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        keyed = (
            spark.readStream.schema(schema).options(**options).parquet(arrivals).groupBy("digest")
            .agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("size"))
        )

        def write(batch: DataFrame, number: int) -> None:  # a batch that is repeated writes the same folder again
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        query = (
            keyed.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _delivered(docs: DataFrame, key: str, text: str, folder: str, delivery: str) -> DataFrame:
    """id, text, file, row of this delivery and of those that the state knows, each from the files it came in.

    Rows that come straight from Parquet files are read from there again by later deliveries; others are first written beside
    the state. The list of files is written once, before the arrivals, so a delivery that is repeated finds the same rows.
    """
    spark = docs.sparkSession
    paths = f"{folder}/sources/{delivery}"
    if not _there(spark, paths):
        rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
        try:
            docs.select(key, text).withColumn("__row", F.col("_metadata.row_index"))
            found, names = docs.inputFiles(), (key, text)
        except AnalysisException:
            rows.write.mode("overwrite").parquet(f"{folder}/texts/{delivery}")
            found, names = [f"{folder}/texts/{delivery}"], ("id", "text")
        listed = [(delivery, path, *names) for path in found]
        spark.createDataFrame(listed, "delivery string, path string, key string, text string").coalesce(1).write.mode("overwrite").parquet(paths)
    every: dict[tuple, list[str]] = {}
    for r in spark.read.parquet(f"{folder}/sources/*").collect():  # a row a file, which the driver lists anyway
        every.setdefault((r["key"], r["text"], r["delivery"]), []).append(r["path"])
    out = None
    for (k, t, name), files in sorted(every.items(), key=lambda x: x[0][2]):
        part = located(spark.read.parquet(*files).select(F.col(k).alias("id"), text_or_empty(t).alias("text"))).withColumn("delivery", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"__file": "file", "__row": "row"})


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    options: dict[str, str] | None = None, state: str | None = None, delivery: str = "0",
) -> DataFrame:
    """key, keep_id, group_size, kept, digest, file, row: one row per document, those that go included.

    With a ``state`` folder, the state outlives the call: further calls with that folder and another ``delivery`` name take their
    documents against all that came before, and give the groups of all documents so far, as one call with all of them would.
    Earlier texts are found by their locators, in the files they came in, which must still be there. A call that broke off is
    repeated under its name. Without one, the state goes with the other intermediate tables.
    """
    spark = docs.sparkSession
    body = text_or_empty(text)
    folder = state.rstrip("/") if state else new_folder(spark, "exact")
    if state:
        rows = _delivered(docs, key, text, folder, delivery).withColumn("digest", digest(F.col("text")))
        new = rows.filter(F.col("delivery") == delivery).drop("delivery")
        rows = rows.drop("delivery")
    else:
        rows = new = located(docs.select(key, text)).select(
            F.col(key).alias("id"), digest(body).alias("digest"), F.col("__file").alias("file"), F.col("__row").alias("row"), body.alias("text")
        )
    arrivals_at, updates_at = f"{folder}/arrivals", f"{folder}/updates"
    arrivals = new.select("id", "digest", "file", "row")
    if not _there(spark, f"{arrivals_at}/{delivery}"):
        arrivals.write.mode("overwrite").parquet(f"{arrivals_at}/{delivery}")
    schema = arrivals.schema
    arrivals = spark.read.schema(schema).parquet(f"{arrivals_at}/*")
    if arrivals.isEmpty():
        return _shown(arrivals.withColumns({"keep": F.struct("id", "file", "row"), "size": F.lit(1).cast("bigint")}), key)
    run_stream(spark, f"{arrivals_at}/*", schema, f"{folder}/state", updates_at, {"maxBytesPerTrigger": str(BYTES_PER_TRIGGER)} | (options or {}))
    states = (
        spark.read.parquet(updates_at).groupBy("digest")
        .agg(F.max_by(F.struct("keep", "size"), "batch").alias("s")).select("digest", "s.keep", "s.size")
    )
    hits = stored(states.filter("size > 1"), "hits")
    # Only the texts of hits are moved, to stand beside the text that the state's locator points to.
    texts = keep_possible(rows, F.col("digest"), hits, F.col("digest")).join(hits, "digest")
    texts = stored(texts, "hit-texts", "zstd")
    here = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    kept_texts = texts.filter(here).select("digest", F.col("text").alias("kept_text"))
    # Stored before they are made distinct: with nothing behind it that needs whole digests, Spark can split the join at a large group.
    differ = stored(texts.join(kept_texts, "digest").filter(F.col("text") != F.col("kept_text")).select("digest"), "differ").distinct()
    placed = arrivals.join(hits, "digest", "left")
    if not differ.isEmpty():
        mixed = texts.drop("keep", "size").join(differ, "digest", "left_semi")
        exact = mixed.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("size"))
        by_text = mixed.join(exact, ["digest", "text"]).drop("text")
        placed = placed.join(differ, "digest", "left_anti").unionByName(by_text)
    return _shown(placed, key)


def _shown(placed: DataFrame, key: str) -> DataFrame:
    alone = F.col("keep").isNull()
    return placed.select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))).alias("kept"),
        "digest", "file", "row",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = packed(docs)
    judged = rows.select(F.col("__doc")[key].alias("key"), F.col("__doc")[text].alias("text"))

    def dropped() -> DataFrame:
        return groups(judged, "key", "text").filter(~F.col("kept")).select(F.col("file").alias("__file"), F.col("row").alias("__row"))

    return without(rows, ["__file", "__row"], settled(docs.sparkSession, dropped, "dropped")).select("__doc.*")
