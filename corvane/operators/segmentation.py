"""Checks of evidence units against the articles they were cut from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def check_units(units_: DataFrame, parents: DataFrame, key: str, text: str) -> DataFrame:
    """Of each kind of defect the number of units or parents: exact text, order, overlap, signs that no unit covers."""
    before = F.lag("end_char").over(W.partitionBy(key).orderBy("start_char", "end_char"))
    u = units_.withColumn("before", before).join(parents.select(F.col(key), F.col(text).alias("__text")), key)
    exact = F.expr("substring(__text, start_char + 1, end_char - start_char)") == F.col("text")
    per = u.groupBy(key).agg(
        F.count_if(~exact).alias("inexact"), F.count_if(F.col("before") > F.col("start_char")).alias("overlap"),
        F.sum(F.length(F.regexp_replace("text", r"[\s\x{3000}]", ""))).alias("covered"), F.first(F.length(F.regexp_replace("__text", r"[\s\x{3000}]", ""))).alias("visible"),
    )
    return per.agg(F.count(F.lit(1)).alias("parents"), F.sum("inexact").alias("inexact"), F.sum("overlap").alias("overlap"), F.count_if(F.col("covered") != F.col("visible")).alias("uncovered"))
