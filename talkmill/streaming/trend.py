"""Activity per day, by event time, as files of arrivals come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: When something happened, and how many there were; a row with none only moves the clock.
ARRIVALS = "at timestamp, n bigint"
#: How late an arrival may be. Its day stays open that long after it ended, by the clock of the newest arrival.
DELAY = "1 day"


def write_arrivals(rows: DataFrame, at: Column, folder: str) -> None:
    rows.select(at.cast("timestamp").alias("at"), F.lit(1).cast("bigint").alias("n")).write.mode("append").parquet(folder)


def close_days(spark: SparkSession, folder: str, until: Column) -> None:
    """Move the clock, so that days that ended DELAY before ``until`` are closed though nothing newer arrived."""
    spark.range(1).select(until.cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("n")).write.mode("append").parquet(folder)


def trend_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str = DELAY) -> None:
    """Take what has arrived since the last call, and append the days that are closed now.

    A day is written once, when no arrival for it can be taken any more; one that comes later still is dropped. State holds open
    days only: a row a day, whatever number of arrivals they have. A batch that Spark delivers again writes its folder again.
    """
    rows = spark.readStream.schema(ARRIVALS).parquet(folder)
    days = rows.withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("w")).agg(F.sum("n").alias("count"))

    def write(batch: DataFrame, number: int) -> None:
        closed = batch.filter("count > 0").select(F.to_date("w.start").alias("day"), "count")
        closed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = days.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write)
    stream.start().awaitTermination()


def closed_days(spark: SparkSession, out: str) -> DataFrame:
    """day, count of all closed days."""
    return spark.read.schema("day date, count bigint, batch int").parquet(out).drop("batch")
