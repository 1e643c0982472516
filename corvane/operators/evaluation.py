"""Paired comparisons, resampling, dominance and hash samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def paired_counts(delta: str, tie: float = 1e-12) -> list[Column]:
    d = F.col(delta)
    return [F.count_if(d > tie).alias("improved"), F.count_if(F.abs(d) <= tie).alias("tied"), F.count_if(d < -tie).alias("degraded")]


def bootstrap(df: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """mean, low and high (2.5 and 97.5 %) of the mean over resamples.

    Each row's weight in a replicate is a Poisson(1) draw that follows from a hash of seed, replicate and key, so the
    result doesn't depend on partitioning. Rows are summed up before the exchange: only replicates' sums are moved.
    """
    draws = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")
    x = df.select(key, value, draws).withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "b", key), F.lit(1 << 30)) / float(1 << 30))
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        steps.append((total, k))
        p /= k + 1
    weight = F.lit(12)
    for bound, k in reversed(steps):
        weight = F.when(F.col("u") < bound, k).otherwise(weight)
    means = x.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def pareto(df: DataFrame, more: list[str], less: list[str]) -> DataFrame:
    """The rows that no other row beats or equals everywhere and beats somewhere. For tables of candidates (configurations)."""
    cols = [*more, *less]
    points = df.select(*cols).distinct()
    a, b = points.alias("a"), points.alias("b")
    good = [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in more] + [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in less]
    better = [F.col(f"b.{c}") > F.col(f"a.{c}") for c in more] + [F.col(f"b.{c}") < F.col(f"a.{c}") for c in less]
    every, some = good[0], better[0]
    for g in good[1:]:
        every = every & g
    for s in better[1:]:
        some = some | s
    front = a.join(b, every & some, "left_anti")
    return df.join(front, cols, "left_semi")


def hash_fraction(df: DataFrame, key: str, salt: str, fraction: float) -> DataFrame:
    """The first ceil(fraction * n) rows in the order of sha256(salt + key), then key.

    Hashes are counted by their first four digits; only the rows of the one bucket in which the count is reached are
    ranked, so there is no global sort.
    """
    hashed = df.select(key, F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256).alias("__h")).withColumn("__b", F.substring("__h", 1, 4))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    want = counts.agg(F.ceil(F.sum("__n") * fraction).alias("__want"))
    upto = F.sum("__n").over(W.orderBy("__b"))  # one row for each of at most 65536 buckets
    marked = counts.withColumn("__before", upto - F.col("__n")).crossJoin(F.broadcast(want))
    full = hashed.join(marked, "__b").filter(F.col("__before") < F.col("__want"))
    rank = F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    return full.withColumn("__r", rank).filter(F.col("__before") + F.col("__r") <= F.col("__want")).select(key)


def pair_metrics(records: DataFrame, key: str) -> DataFrame:
    """One row of eight rates over records (key, variant, visible, required, summary, refuse, cited).

    variant is sufficient or insufficient; a key with both is a pair. A rate without anything to count is 0. Recall of
    required citations is over all ids together. A record's protocol holds if its summary is one line.
    """
    ids = lambda a, b: F.size(F.array_intersect(a, b))
    enough, valid, told = F.col("variant") == "sufficient", ~F.contains("summary", F.lit("\n")), F.col("summary") != ""
    within = F.size(F.array_except("cited", "visible")) == 0
    hard = F.array_except("visible", "required")
    x = records.withColumns({
        "valid": valid, "within": within, "found": ids("required", "cited"), "n": F.size(F.array_distinct("required")), "tempting": F.size(hard) > 0, "tempted": ids(hard, "cited") > 0,
        "refused": ~enough & valid & F.col("refuse"), "shaped": ~enough & valid & F.col("refuse") & ~told & (F.size("cited") == 0),
    })
    x = x.withColumn("success", enough & F.col("valid") & ~F.col("refuse") & told & F.col("within") & (F.col("found") == F.col("n")) & ~F.col("tempted"))
    rate = lambda hit, of: F.coalesce(F.round(F.try_divide(F.count_if(hit & of), F.count_if(of)), 6), F.lit(0.0))
    every = F.lit(True)
    one = x.agg(
        rate(F.col("valid"), every).alias("protocol_valid"), rate(F.col("success"), enough).alias("answer_success"), rate(F.col("refused"), ~enough).alias("refusal_correct"),
        F.round(F.try_divide(F.sum(F.when(enough, F.col("found"))), F.sum(F.when(enough, F.col("n")))), 6).alias("citation_recall"), rate(~F.col("within"), every).alias("invalid_citation"),
        rate(F.col("tempted"), enough & F.col("tempting")).alias("hard_negative_citation"), rate(F.col("shaped"), ~enough).alias("refusal_shape"),
    )
    pairs = x.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.bool_or("success").alias("a"), F.bool_or("shaped").alias("b")).filter("k = 2")
    paired = pairs.agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("a") & F.col("b")), F.count(F.lit(1))), 6), F.lit(0.0)).alias("paired_success"))
    return one.crossJoin(F.broadcast(paired))  # one row each


def exact_percentile(df: DataFrame, group: str, value: str, fraction: float, width: float) -> DataFrame:
    """group and the percentile of its values, interpolated between neighbours; null and NaN values don't count.

    Values are counted by buckets of the given width first; only the one or two buckets that hold the wanted ranks are put
    in order, so no task sees all values of a group.
    """
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).withColumn("b", F.floor(F.col("v") / width))
    counts = x.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy("g")
    at = F.lit(fraction) * (F.sum("n").over(of) - 1)
    counts = counts.withColumn("upto", F.sum("n").over(of.orderBy("b"))).withColumn("low", F.floor(at)).withColumn("high", F.ceil(at)).withColumn("part", at - F.floor(at))
    counts = counts.withColumn("before", F.col("upto") - F.col("n")).filter("low < upto and high >= before")
    ranked = x.join(counts.select("g", "b", "before", "low", "high", "part"), ["g", "b"]).withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("g", "b").orderBy("v")) - 1)
    pick = lambda c: F.max(F.when(F.col("k") == F.col(c), F.col("v")))
    out = ranked.filter("k = low or k = high").groupBy("g").agg(pick("low").alias("a"), pick("high").alias("z"), F.first("part").alias("part"))
    return out.select(F.col("g").alias(group), (F.col("a") + (F.col("z") - F.col("a")) * F.col("part")).alias("percentile"))
