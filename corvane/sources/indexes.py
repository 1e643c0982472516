"""Persistent search indexes: built once, published whole, validated when they are loaded, served as searchers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import retrieval as R
from corvane.operators.scoring import Searcher
from corvane.sources import publish

VERSION = "1"


class IndexError_(ValueError):
    """An index on disk that isn't what its manifest says."""


def _manifest(spark: SparkSession, path: str, facts: dict | None = None) -> dict:
    """Write or read the manifest beside an index's tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    system = file.getFileSystem(conf)
    if facts is not None:
        out = system.create(file, False)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        return facts
    if not system.exists(file):
        raise IndexError_(f"{path}: no manifest")
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with its vectors in double precision brought to length 1; null and zero vectors stay out."""
    x = df.withColumn(vector, F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull())
    x = x.withColumn("__n", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))).filter("__n > 0")
    return x.withColumn(vector, F.transform(vector, lambda v: v / F.col("__n"))).drop("__n")


def save_dense(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> dict:
    """Publish vectors, brought to length 1, with a manifest of rows, dimension and digest. The path must not exist."""
    table = unit_vectors(vectors.select(key, vector), vector)
    facts = publish(table, f"{path}/vectors")
    dim = table.agg(F.max(F.size(vector))).first()[0] or 0
    return _manifest(table.sparkSession, path, {"kind": "dense", "version": VERSION, "key": key, "vector": vector, "dim": dim, **facts})


def load_dense(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors of an index and its manifest. Raises unless kind, version, number, dimension, length 1 of every vector
    and uniqueness of keys are as they must be."""
    m = _manifest(spark, path)
    table = spark.read.parquet(f"{path}/vectors")
    norm = F.sqrt(F.aggregate(m["vector"], F.lit(0.0), lambda s, v: s + v * v))
    got = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(m["key"]).alias("keys"), F.count_if(F.size(m["vector"]) != m["dim"]).alias("dim"), F.count_if(~F.coalesce(F.abs(norm - 1) < 1e-6, F.lit(False))).alias("norm")).first()
    if m["kind"] != "dense" or m["version"] != VERSION or got["n"] != m["records"] or got["keys"] != got["n"] or got["dim"] or got["norm"]:
        raise IndexError_(f"{path}: {got.asDict()} for {m}")
    return table, m


def save_sparse(docs: DataFrame, path: str, key: str) -> dict:
    """Publish the postings of all documents (key, text) and their terms' counts, with a manifest."""
    terms = R.tokens(F.col("text"))
    facts = publish(R.postings(docs, key, terms), f"{path}/postings")
    publish(R.term_counts(docs, terms), f"{path}/terms")
    return _manifest(docs.sparkSession, path, {"kind": "sparse", "version": VERSION, "key": key, **facts})


def load_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """postings, terms and manifest of an index. Raises unless their counts agree with each other and with the manifest."""
    m = _manifest(spark, path)
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    n = postings.agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).first()
    s = terms.agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("n"), F.max(F.when(F.col("term").isNull(), F.col("all"))).alias("tf")).first()
    if m["kind"] != "sparse" or m["version"] != VERSION or n["n"] != m["records"] or (n["n"], n["tf"]) != (s["n"], s["tf"]):
        raise IndexError_(f"{path}: {n.asDict()} and {s.asDict()} for {m}")
    return postings, terms, m


def dense_searcher(spark: SparkSession, path: str) -> Searcher:
    """A searcher over a loaded dense index: questions (vec_id, embedding), brought to length 1, and k."""
    table, m = load_dense(spark, path)
    vectors = table.select(F.col(m["key"]).alias("vec_id"), F.col(m["vector"]).alias("embedding"))
    return lambda questions, k: R.dense_search(vectors, unit_vectors(questions.select("vec_id", "embedding"), "embedding"), k)
