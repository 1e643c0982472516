"""Joins in which a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a key from which it is hot. There are at most as many hot keys as all rows divided by it, so they may be broadcast.
HOT = 100_000
SALTS = 32


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, spread: Column) -> DataFrame:
    """The inner join of big and small, which has one row for each key, with the rows of hot keys spread over SALTS tasks.

    rows: the column of small that holds how many rows of big a key has; spread: an integer of big's rows to spread them by.
    """
    often = F.col(rows) > HOT
    hot = F.broadcast(small.filter(often).select(*keys, F.lit(True).alias("__hot")))
    salted = big.withColumn("__spread", spread).join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod("__spread", F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot", "__spread")
    each = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(small.withColumn("__salt", F.explode(each)), [*keys, "__salt"]).drop("__salt")
