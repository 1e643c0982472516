"""Running totals over a long order without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def running_total(df: DataFrame, groups: list[str], order: str, size: str, name: str, span: int) -> DataFrame:
    """df with the total of size up to and with each row, within groups in the order of an integer column.

    The order column is cut into spans of so many values; totals of spans give the offsets, and only rows of one span meet
    in a task. Rows with equal order share their total.
    """
    x = df.withColumn("__b", F.floor(F.col(order) / span))
    sums = x.groupBy(*groups, "__b").agg(F.sum(size).alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum(size).over(W.partitionBy(*groups, "__b").orderBy(order))
    offsets = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col("__b").alias("__c"), before.alias("__o"))
    on = F.col("__b") == F.col("__c")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return x.withColumn("__i", inner).join(offsets, on).withColumn(name, F.col("__o") + F.col("__i")).drop("__b", "__c", "__o", "__i", *[f"__g{k}" for k in range(len(groups))])
