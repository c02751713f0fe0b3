"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: everything between ASCII white space.
GAPS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


#: Folders that the running calls of ``settled`` made, innermost last.
_SCOPES: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return folder


def stored(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Write the rows to the shared folder and read them back, which cuts lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back.stored_in = folder
    return back


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # Spark deletes the files of a shuffle once the driver has collected the last object that could read it again.
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    folders = [t.stored_in for t in tables]
    for scope in _SCOPES:
        scope[:] = [f for f in scope if f not in folders]
    _delete(tables[0].sparkSession, folders)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, codec: str = "zstd") -> DataFrame:
    """Store what ``make`` returns, and delete all that was stored on the way to it.

    From then on only the result can be read, and it is whole: no lost executor can call for what is gone. If ``make`` fails, all
    stays as it is.
    """
    _SCOPES.append([])
    try:
        made = make()
        inner = _SCOPES.pop()
    except BaseException:
        _SCOPES.pop()
        raise
    result = stored(made, name, codec)
    _delete(spark, inner)
    return result


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text, in order; none for an empty one."""
    return F.filter(F.split(text, GAPS), lambda w: w != "")


#: Bits of the hit map: 2^23 in at most 262,144 rows of two longs, so under 10 MB at any input size.
MAP_BITS = 23


def _marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int) -> DataFrame:
    """The rows with ``__maybe``: whether their key may be among the wanted keys.

    The wanted keys are hashed into a map of 2^bits bits, whose size does not grow with the data, and that map is
    broadcast. No wanted row is ever missed; an exact join must follow for the few others.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    bit = F.pow(F.lit(2.0), F.col("__slot") % 32).cast("bigint")
    words = (
        wanted.select(slot(wanted_key).alias("__slot"))
        .groupBy(F.floor(F.col("__slot") / 32).alias("__word"))
        .agg(F.bit_or(bit).alias("__bits"))
    )
    placed = rows.withColumn("__slot", slot(key)).withColumn("__word", F.floor(F.col("__slot") / 32))
    hit = F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(bit) != 0
    return placed.join(F.broadcast(words), "__word", "left").withColumn("__maybe", hit).drop("__word", "__slot", "__bits")


def keep_possible(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = MAP_BITS) -> DataFrame:
    """The rows whose key may be among the wanted keys, without a shuffle of the rows."""
    return _marked(rows, key, wanted, wanted_key, bits).filter("__maybe").drop("__maybe")


def without(rows: DataFrame, key: list[str], dropped: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows whose key columns are not in ``dropped``. Only rows that may be are shuffled."""
    whole = F.struct(*key)
    marked = _marked(rows, whole, dropped, whole, bits)
    others = marked.filter(~F.col("__maybe")).drop("__maybe")
    asked = marked.filter("__maybe").drop("__maybe")
    named = dropped.select(*[F.col(k).alias(f"__d_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in key]
    left = asked.join(named, same, "left_anti")
    return others.unionByName(left)


def located(docs: DataFrame) -> DataFrame:
    """The rows with ``__file`` and ``__row``, where their content stands: a hash of the file's path and the row's number in it.

    Rows that do not come straight from files are first written to the shared folder. For columns chosen by the operator;
    ``packed`` serves rows with columns of any names.
    """
    place = {"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except AnalysisException:
        return stored(docs, "located").withColumns(place)


def packed(docs: DataFrame) -> DataFrame:
    """Every row as a struct ``__doc``, so that its columns clash with no name used here, with ``__file`` and ``__row``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    if "_metadata" in docs.columns:
        return located(stored(docs.select(whole), "packed"))
    return located(docs.select(whole))


def positions(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of every group from 0 in the given order, without gathering a group in one task.

    Rows are range-partitioned and sorted by group and order, and stored, so that a lost executor cannot shift a number. A row's
    number is its place in its partition plus the rows that its group has in earlier ones; only one row per group and partition is
    summed up. The group's columns are never null, and the order is total or leaves only rows that are alike. The rows are
    computed twice, the first time to find the ranges, so they should come from a stored table.
    """
    keys = [F.col(c) for c in group]
    at = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", at), "positions")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return placed.join(starts, [*group, "__part"]).withColumn(name, F.col("__at") + F.col("__start")).drop("__at", "__part", "__start")
