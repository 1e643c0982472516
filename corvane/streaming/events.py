"""Streaming forms of the event analytics: file source, watermarks, windows, deduplication, idempotent sink, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.runtime import work_path


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, with the schema of what lies there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str, width: str) -> DataFrame:
    """Counts by type in windows of event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, late: str, key: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run the stream over all that is there and give what it wrote. Each batch goes to a folder of its own that a repeat
    of the batch overwrites, so a restart writes nothing twice. With the same out and state a later run goes on where the
    one before it ended."""
    spark = stream.sparkSession
    out, state = out or work_path(spark, "stream"), state or work_path(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).drop("batch")
