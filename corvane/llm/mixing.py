"""Mixing sources to target weights by weighted fair queueing.

Each record of a source gets a place in the source's shuffled queue and a virtual finish time: the size of the queue up
to and with it, divided by the source's target. Taken in order of finish time, the sources advance in the proportion of
their targets; a source starts over, with the same order, when it is used up, at most max_repeat times. The mix is cut at
the total budget.

Places are computed without sorting a source in one task: the shuffle key is a hash, its upper bits are an order-preserving
bucket, and a record's place is the offset of its bucket plus its place in the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvane.runtime import materialize

BUCKET_BITS = 12


def prefix_in_order(df: DataFrame, groups: list[str], bucket: str, order: list[Column], sizes: dict[str, Column]) -> DataFrame:
    """df with running totals up to and with each row, one for each of sizes by its name, within groups, by bucket, then order.

    bucket must be an integer that never falls as the order goes on. No task sees more than one bucket of a group, and the
    offsets of a group are a window over one row per bucket.
    """
    sized = df.withColumns({f"__size_{n}": c.cast("long") for n, c in sizes.items()})
    totals = sized.groupBy(*groups, bucket).agg(*[F.sum(f"__size_{n}").alias(f"__total_{n}") for n in sizes])
    over = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, bucket, *[F.coalesce(F.sum(f"__total_{n}").over(over), F.lit(0)).alias(f"__offset_{n}") for n in sizes])
    inner = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = sized.withColumns({f"__inner_{n}": F.sum(f"__size_{n}").over(inner) for n in sizes}).join(offsets, [*groups, bucket])
    return running.withColumns({n: F.col(f"__offset_{n}") + F.col(f"__inner_{n}") for n in sizes}).drop(*[f"__{k}_{n}" for k in ("size", "inner", "offset") for n in sizes])


def _bounded(want: DataFrame) -> DataFrame:
    """want with supply, budget and take: how much of each queue the cut at the plan's budget can reach at most.

    With all queues drawn up to a finish time t, a plan holds the sum of min(t * target, supply); it is the least, over
    all sets of queues taken as used up, of their supply plus t times the targets of the others. The cut therefore lies
    at the largest t that any such set gives, and only sets of those used up first matter. Sizes of whole records leave a
    rest, for which a queue may be drawn on by one record of each source.
    """
    own = W.partitionBy("plan")
    by = own.orderBy(F.col("supply") / F.col("target"), "source")
    x = want.withColumn("supply", F.col("total") * F.col("max_repeat"))
    x = x.withColumn("gone", F.sum("supply").over(by.rowsBetween(W.unboundedPreceding, -1))).withColumn("open", F.sum("target").over(by.rowsBetween(0, W.unboundedFollowing)))
    level = F.max((F.col("budget") - F.coalesce("gone", F.lit(0))) / F.col("open")).over(own)
    margin = F.sum("largest").over(own)
    return x.withColumn("take", F.least("supply", F.ceil(F.col("target") * level) + margin)).drop("gone", "open", "largest")


def mix(records: DataFrame, targets: DataFrame, block: int = 4096) -> DataFrame:
    """Mix the records of each plan's pool.

    records: pool, source, id, size (a null or negative size counts as 0; such records are never drawn).
    targets: plan, pool, source, seed, target (size asked for; null or below 0 asks for none), max_repeat (null: 1).
    Gives plan, position (from 1, by finish time), source, id, use (1 for the first use), finish, size. Every source is
    queued, with its repeats up to max_repeat; the queues are merged by finish time, and the mix is cut off where its size
    would exceed the plan's budget, the sum of its targets. So the sources stand in the proportion of their targets in
    every front part of the mix in which none is used up; a source that is used up leaves its room to the others, up to
    the budget. Records that are alike in pool, source and id are one record. Empty tables give no rows; null pools,
    sources or ids belong to nothing. Ties in the hash and in finish time go by source and id.
    """
    rec = records.select(F.col("pool"), F.col("source"), F.col("id").cast("string").alias("id"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    rec = rec.filter("pool is not null and source is not null and id is not null and size > 0").dropDuplicates(["pool", "source", "id"])
    rec, want = materialize(rec, "mix-records"), materialize(wanted(targets), "mix-targets")
    salts = 32
    draws = want.filter("target > 0").select("pool", "source", "seed").distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    queue = rec.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(draws, ["pool", "source", "__salt"]).drop("__salt")
    queue = queue.withColumn("__h", F.xxhash64(F.col("seed"), F.col("id"))).withColumn("__b", F.shiftrightunsigned("__h", 64 - BUCKET_BITS))
    queue = prefix_in_order(queue, ["pool", "source", "seed"], "__b", [F.asc("__h"), F.asc("id")], {"upto": F.col("size")}).drop("__h", "__b")
    queue = materialize(queue, "mix-queue")
    total = rec.groupBy("pool", "source").agg(F.sum("size").alias("total"), F.max("size").alias("largest"))
    budget = want.groupBy("plan").agg(F.sum("target").alias("budget"))
    want = materialize(_bounded(want.join(budget, "plan").join(total, ["pool", "source"]).filter("target > 0 and max_repeat > 0")), "mix-asks")
    # Plans meet their pool's queue block by block, so that neither a large pool nor a large plan is one task's work.
    asks = want.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.least("take", "total") - 1) / block))))
    drawn = asks.join(queue.withColumn("__block", F.floor((F.col("upto") - 1) / block)), ["pool", "source", "seed", "__block"])
    drawn = drawn.filter(F.col("upto") <= F.col("take"))
    drawn = drawn.withColumn("use", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - F.col("upto")) / F.col("total")))))
    drawn = drawn.withColumn("finish", (F.col("use") * F.col("total") + F.col("upto")) / F.col("target"))
    drawn = drawn.select("plan", "budget", "source", "id", "use", "finish", "size", F.floor(F.col("finish") * 4096).cast("long").alias("__b"))
    drawn = materialize(drawn, "mix-drawn")
    placed = prefix_in_order(drawn, ["plan"], "__b", [F.asc("finish"), F.asc("source"), F.asc("id")], {"position": F.lit(1), "reached": F.col("size")})
    placed = placed.filter(F.col("reached") <= F.col("budget"))
    return placed.select("plan", "position", "source", "id", (F.col("use") + 1).alias("use"), "finish", "size")


def wanted(targets: DataFrame) -> DataFrame:
    """targets, one row for each plan and source, with the defaults for nulls put in."""
    zero = F.lit(0).cast("long")
    return targets.filter("plan is not null").select(
        "plan", "pool", "source", F.coalesce(F.col("seed").cast("long"), zero).alias("seed"),
        F.greatest(F.coalesce(F.col("target").cast("long"), zero), zero).alias("target"),
        F.greatest(F.coalesce(F.col("max_repeat").cast("long"), F.lit(1)), zero).alias("max_repeat"),
    ).dropDuplicates(["plan", "source"])


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each plan and source: target, filled, target_share and actual_share (null where the plan's whole mix is empty)."""
    filled = mixed.groupBy("plan", "source").agg(F.sum("size").alias("filled"))
    both = wanted(targets).select("plan", "source", "target").join(filled, ["plan", "source"], "left").fillna(0, ["filled"])
    sums = both.groupBy("plan").agg(F.sum("target").alias("__t"), F.sum("filled").alias("__f"))
    both = both.join(sums, "plan")
    return both.select("plan", "source", "target", "filled", F.try_divide("target", "__t").alias("target_share"), F.try_divide("filled", "__f").alias("actual_share"))


def plan_inputs(candidates: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records and targets of mix() for sft_candidate and clean_scale_plan.

    Slices: hard_negative; clean records are paired_clean if their query_id also has a hard negative in the pool, else
    unpaired_clean. Labels that differ in case, blanks or separator are one; records without a label belong to no slice.
    """
    from corvane.runtime import one_per_key, uniform_label

    rec = one_per_key(candidates.select("id", "pool_no", "query_id", uniform_label(F.col("variant")).alias("variant")), "id")
    rec = rec.filter(F.col("variant").isin("clean", "hard_negative"))
    hard = rec.filter("variant = 'hard_negative'").select("pool_no", "query_id").distinct().withColumn("paired", F.lit(True))
    rec = rec.join(hard, ["pool_no", "query_id"], "left")
    slice_ = F.when(F.col("variant") == "hard_negative", "hard_negative").when(F.col("paired"), "paired_clean").otherwise("unpaired_clean")
    records = rec.select(F.col("pool_no").alias("pool"), slice_.alias("source"), "id", F.lit(1).alias("size"))
    plan = one_per_key(plans, "plan_id")
    none = F.lit(0)
    paired = F.coalesce("paired_clean_count", none)
    each = F.array(
        F.struct(F.lit("paired_clean").alias("source"), paired.alias("target")),
        F.struct(F.lit("unpaired_clean").alias("source"), (F.coalesce("clean_count", none) - paired).alias("target")),
        F.struct(F.lit("hard_negative").alias("source"), F.coalesce("hard_negative_count", none).alias("target")),
    )
    targets = plan.select(F.col("plan_id").alias("plan"), F.col("pool_no").alias("pool"), F.col("subset_seed").alias("seed"), "max_repeat", F.explode(each).alias("x"))
    return records, targets.select("plan", "pool", "seed", "max_repeat", "x.source", "x.target")
