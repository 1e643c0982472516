"""Streaming queries, run over the events that are there until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.base import registry
from corvane.streaming import events as E

QUERIES, query = registry()


def _stream(t):
    """The events as files that arrive one after the other in the order of time, so that a short watermark drops nothing."""
    from corvane.runtime import work_path

    e = t("events")
    path = work_path(e.sparkSession, "events")
    for k in range(4):
        e.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == k).coalesce(1).write.mode("append").parquet(path)
    return E.event_stream(e.sparkSession, path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_deduplicated(t):
    """Counts of a stream that holds each event once; keys are remembered for two days of event time."""
    return E.drain(E.once(_stream(t), "2 days", "event_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    """Daily windows of a stream in update mode: each batch writes the windows it changed, and windows older than the
    watermark are forgotten. The latest count of a window is its highest."""
    counts = E.windowed_counts(_stream(t), "2 days", "1 day")
    last = E.drain(counts, "update")
    return last.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n").groupBy("event_type", "start").agg(F.max("n").alias("n"))
