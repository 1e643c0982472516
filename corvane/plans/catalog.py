"""All queries for the reference's operators, each with its SQL for the oracle where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.runtime import table

MODULES = ("retrieval", "questions", "contracts", "answers", "evaluation", "experiments", "corpus", "integrity", "sampling", "relational", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        for key, (f, _) in importlib.import_module(f"corvane.plans.{name}").QUERIES.items():
            out[key] = lambda spark, sf_dir, f=f: f(lambda t: table(spark, sf_dir, t))
    return out


def oracle_sql() -> dict[str, str]:
    return {key: sql for name in MODULES for key, (_, sql) in importlib.import_module(f"corvane.plans.{name}").QUERIES.items() if sql}
