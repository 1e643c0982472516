"""Deterministic orders, quotas, exposures and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hash_key(salt: str, *columns: str) -> Column:
    """The hash that fixes a deterministic order: hexadecimal SHA-256 of salt and the columns, parted by a zero sign."""
    return F.sha2(F.concat_ws("\x00", F.lit(salt), *[F.col(c).cast("string") for c in columns]), 256)


def first_by_hash(df: DataFrame, groups: list[str], key: str, salt: str, n: int) -> DataFrame:
    """The first n rows of each group in hash order, ties by key, with place. The cut is a group limit before the exchange.

    Without groups each partition's first n go on to the one in which they are placed.
    """
    if not groups:
        df = df.orderBy(hash_key(salt, key), F.col(key)).limit(n)
    order = W.partitionBy(*groups).orderBy(hash_key(salt, key), F.col(key))
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def quotas(strata: DataFrame, groups: list[str], size: str, total: int) -> DataFrame:
    """strata with quota: total shared out by size, by largest remainder; equal remainders go in the order of a hash.

    strata holds one row for each stratum; the places by remainder are the only global order, over strata, not records.
    """
    all_ = F.sum(size).over(W.partitionBy())
    share = F.col(size) * total
    x = strata.withColumn("__all", all_).withColumn("quota", F.floor(share / F.col("__all"))).withColumn("__rest", share % F.col("__all"))
    left = total - F.sum("quota").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc("__rest"), F.sha2(F.concat_ws("\x00", *groups), 256)))
    return x.withColumn("__left", left).withColumn("__place", place).withColumn("quota", F.col("quota") + (F.col("__place") <= F.col("__left")).cast("long")).drop("__all", "__rest", "__left", "__place")


def exposures(df: DataFrame, key: str, total: Column, count: Column) -> DataFrame:
    """Each row floor(total / count) times or once more: cycle is the number of the use, from 0."""
    whole = F.floor(total / count)
    return df.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), whole)))


def packed_sequences(df: DataFrame, group: str, tokens: str, length: int) -> DataFrame:
    """Of each group the full sequences its tokens fill, and the tail that is dropped."""
    x = df.groupBy(group).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
    return x.select(group, "tokens", F.floor(F.col("tokens") / length).alias("sequences"), (F.col("tokens") % length).alias("dropped"))
