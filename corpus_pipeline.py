"""The corpus pipeline: quality rules, exact deduplication, near-duplicate removal, packing.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import exact, jaccard, packing, quality
from talkmill.llm.common import forget, packed, settled, stored, without
from talkmill.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the current policy. Rows that repeat a key are judged by their own texts."""
    rows = packed(docs)
    keyed = rows.select(F.struct("__file", "__row").alias("place"), F.col("__doc.text").alias("text"))

    def rejected() -> DataFrame:
        judged = quality.apply_policy(stored(quality.ledger(keyed, "place"), "ledger"))
        return judged.filter(~F.col("kept")).select("place.__file", "place.__row")

    return without(rows, ["__file", "__row"], settled(spark, rejected, "rejected")).select("__doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup), ("packing", pack),
]

#: Tokens and shingle components are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the result of each is written and read again. What a stage stored, and the result it read, goes
    when its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        made = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            forget(docs)
        docs = made
    return docs
