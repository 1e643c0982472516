"""Logs of typed records: last runs, traces, failures, tool runs; choice of a candidate that doesn't lose.

All are aggregates by run, so that records of a run are put together before they are exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def last_run(log: DataFrame, run: list[str], order: str, kind: str, start: str, complete: str) -> DataFrame:
    """run, started (the last start), completed (the last completion after it, null if none) and state: none, running, complete."""
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(order)))
    x = log.groupBy(*run).agg(at(start).alias("started"), at(complete).alias("done"))
    done = F.col("done") > F.col("started")
    return x.select(*run, "started", F.when(done, F.col("done")).alias("completed"), F.when(F.col("started").isNull(), "none").when(done, "complete").otherwise("running").alias("state"))


def traces(log: DataFrame, run: list[str], order: str, kind: str, start: str, final: tuple[str, ...]) -> DataFrame:
    """run, events, first_kind, final_kind, finals, and complete: begun by start, ended by the only final event."""
    x = log.groupBy(*run).agg(F.count(F.lit(1)).alias("events"), F.min_by(kind, order).alias("first_kind"), F.max_by(kind, order).alias("final_kind"), F.count_if(F.col(kind).isin(*final)).alias("finals"))
    return x.withColumn("complete", (F.col("first_kind") == start) & F.col("final_kind").isin(*final) & (F.col("finals") == 1))


def failure_codes(log: DataFrame, run: list[str], order: str, kind: str, failure: str) -> DataFrame:
    """run and code: completed, failed_at_start, or failed_after_ the kind of record before the first failure."""
    x = log.withColumn("__before", F.lag(kind).over(W.partitionBy(*run).orderBy(order))).groupBy(*run)
    failed = F.col(kind) == failure
    x = x.agg(F.count_if(failed).alias("__n"), F.min_by(F.struct("__before"), F.when(failed, F.col(order))).alias("__b"))
    return x.select(*run, F.when(F.col("__n") == 0, "completed").otherwise(F.coalesce(F.concat(F.lit("failed_after_"), F.col("__b")["__before"]), F.lit("failed_at_start"))).alias("code"))


def last_known(log: DataFrame, run: list[str], order: str, value: str) -> DataFrame:
    """run and the last value that isn't null."""
    return log.groupBy(*run).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def tool_runs(log: DataFrame, run: list[str], order: str, kind: str, kinds: dict[str, str], most: int) -> DataFrame:
    """run, searches and verdict: too_many_searches, answered_after_miss, hit_not_promoted or valid.

    kinds names the kinds of search, hit, answer and miss. A miss before the last answer blocks it; the last answer must
    stand after the last hit.
    """
    at = lambda f, k: f(F.when(F.col(kind) == kinds[k], F.col(order)))
    x = log.groupBy(*run).agg(F.count_if(F.col(kind) == kinds["search"]).alias("searches"), at(F.max, "hit").alias("__hit"), at(F.max, "answer").alias("__answer"), at(F.min, "miss").alias("__miss"))
    lost = F.col("__hit").isNotNull() & F.coalesce(F.col("__answer") < F.col("__hit"), F.lit(True))
    verdict = F.when(F.col("searches") > most, "too_many_searches").when(F.col("__miss") < F.col("__answer"), "answered_after_miss").when(lost, "hit_not_promoted").otherwise("valid")
    return x.select(*run, "searches", verdict.alias("verdict"))


def non_degrading(scores: DataFrame, key: str, candidate: str, baseline: str, by: list[str]) -> DataFrame:
    """key, chosen (the best candidate, by scores and then name, if it isn't below the baseline; else noop), and the first
    score of the baseline and of the best candidate."""
    base = F.max(F.when(F.col(candidate) == baseline, F.struct(*by))).alias("__base")
    best = F.max(F.when(F.col(candidate) != baseline, F.struct(*by, F.col(candidate).alias("__name")))).alias("__best")
    x = scores.groupBy(key).agg(base, best)
    kept = F.struct(*[F.col("__best")[c].alias(c) for c in by]) >= F.col("__base")
    return x.select(key, F.when(kept, F.col("__best")["__name"]).otherwise("noop").alias("chosen"), F.col("__base")[by[0]].alias("baseline_hits"), F.col("__best")[by[0]].alias("candidate_hits"))
